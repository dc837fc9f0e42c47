import math

from tests.helpers import duck, same
from tidemark.llm.mixing import OP1_SQL, mix, op1_mixing, rates


def test_query_equals_sql(spark, sf_dir):
    same(op1_mixing(spark, sf_dir), duck(sf_dir), OP1_SQL)


def test_shares_and_poisson_counts(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "case when id % 10 < 8 then 'a' when id % 10 = 8 then 'b' else 'c' end source", "'t' text")
    mixed = mix(docs, {"a": 0.2, "b": 0.5}).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 20_000 for r in mixed}
    assert all(abs(share[k] - v) < 0.02 for k, v in {"a": 0.2, "b": 0.5, "c": 0.3}.items())
    copies = mix(docs.filter("source = 'a'"), {"a": 1.0}).groupBy("doc_id").count().groupBy("count").count().collect()
    n = {r["count"]: r[1] for r in copies}
    assert all(abs(n[k] / 16_000 - math.exp(-1) / math.factorial(k)) < 0.015 for k in (1, 2, 3))


def test_large_rates_are_summed_from_parts(spark):
    docs = spark.range(400).selectExpr("id doc_id", "case when id < 20 then 'rare' else 'rest' end source", "'t' text")
    assert rates(docs, {"rare": 0.9}, size=20_000).filter("bucket = 'rare'").first()["parts"] > 100
    n = mix(docs, {"rare": 0.9}, size=20_000).filter("source = 'rare'").count()
    assert abs(n - 18_000) < 6 * 18_000**0.5


def test_odd_rows(odd, empty):
    mixed = mix(odd, {"src0": 0.5, "nobody": 0.1}, size=5_000)
    assert mix(empty, {"src0": 0.5}).isEmpty()
    assert mixed.columns == odd.columns
    assert abs(mixed.filter("source = 'src0'").count() - 2_500) < 800
    assert mixed.filter("doc_id is null").count() > 0 and mixed.filter("source is null").count() > 0
    assert mixed.exceptAll(mix(odd, {"src0": 0.5, "nobody": 0.1}, size=5_000)).isEmpty()
    # the rows are those of docs, with their own values
    assert mixed.distinct().exceptAll(odd.distinct()).isEmpty()
