import random
from bisect import bisect_right
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join

FACTS, VERSIONS = "id long, k string, at long", "k string, since long, value long"


def plain(facts, versions, base=None):
    of = defaultdict(list)
    for k, since, value in versions:
        if k is not None and since is not None:
            of[k].append((since, value))
    for v in of.values():
        v.sort()
    out = []
    for i, k, at in facts:
        n = bisect_right(of.get(k, []), (at, float("inf"))) if k is not None and at is not None else 0
        out.append((i, k, at, of[k][n - 1][1] if n else base))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_equals_the_definition(spark, parts):
    """A hot key, facts of one time, ties of versions, nulls, keys without versions or facts."""
    draw = random.Random(int(parts))
    key = lambda: draw.choice(["hot", "hot", "hot", "a", "b", "c", None, str(draw.randrange(30))])
    facts = [(i, key(), draw.choice([None, 500, 500, draw.randrange(1000)])) for i in range(3000)]
    versions = [(key(), draw.choice([None, draw.randrange(1000), draw.randrange(20) * 50]), draw.randrange(9)) for _ in range(800)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = asof_join(spark.createDataFrame(facts, FACTS), spark.createDataFrame(versions, VERSIONS), "k", "at", "since", ["value"], {"value": F.lit(-1).cast("long")})
        assert sorted((tuple(r) for r in df.collect()), key=repr) == plain(facts, versions, -1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_key_of_many_versions(spark):
    """100,000 versions and 100,000 facts of one key: no pairs, no residual join."""
    versions = spark.range(100_000).selectExpr("'k' k", "id * 10 since", "id value")
    facts = spark.range(100_000).selectExpr("id", "'k' k", "id * 10 + 3 at")
    df = asof_join(facts, versions, "k", "at", "since", ["value"])
    assert df.filter("value <> id").count() == 0 and df.count() == 100_000
    plan = df._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides_and_clashing_names(spark):
    facts, versions = spark.createDataFrame([(1, "a", 5)], FACTS), spark.createDataFrame([], VERSIONS)
    assert asof_join(facts, versions, "k", "at", "since", ["value"]).first() == (1, "a", 5, None)
    assert asof_join(facts.limit(0), versions, "k", "at", "since", ["value"]).isEmpty()
    # a version whose columns are null is a version all the same
    one = spark.createDataFrame([("a", 1, None)], VERSIONS)
    assert asof_join(facts, one, "k", "at", "since", ["value"], {"value": F.lit(9)}).first()[3] is None
