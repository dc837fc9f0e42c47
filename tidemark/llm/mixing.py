"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, read

#: Target shares of the mixture in documents; the sources not named share what is left in their natural proportions.
WEIGHTS = {"src0": 0.15, "src1": 0.08, "src2": 0.08, "src3": 0.02}
SEED = 7
#: A Poisson count with a larger mean is summed from counts with means up to this, each with a uniform of its own.
PART = 8.0
#: Terms of the distribution that are inverted: beyond them, a mean of PART leaves less than the uniforms' step of 2^-52.
TERMS = 50
OTHERS = "\x00others"


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) of 52 bits, from the MD5 of the parts joined by ':' (nulls read as '~')."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], size: float | None = None) -> DataFrame:
    """(bucket, rate, parts, steps), one row per named source and one for all others: the mean repetition rate is
    weight * size / documents. size: documents of the mixture, None for as many as there are.

    parts is the number of Poisson counts that are summed, steps the cumulative distribution of each. Named sources
    without documents and a mixture without other sources lose their weight to nobody: the mixture is that much
    smaller.
    """
    if min(weights.values(), default=0) < 0 or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are shares: none negative, at most 1 together")
    rest = max(0.0, 1.0 - sum(weights.values()))
    pairs = [x for k, w in [*weights.items(), (OTHERS, rest)] for x in (F.lit(k), F.lit(float(w)))]
    counts = docs.groupBy(bucket_of(F.col("source"), weights).alias("bucket")).agg(F.count("*").alias("n"))
    # at most len(weights) + 1 rows, so the one task of the sum and the broadcast are bounded by the configuration
    if size is None:
        counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy()).cast("double"))
    else:
        counts = counts.withColumn("total", F.lit(float(size)))
    rate = F.element_at(F.create_map(*pairs), F.col("bucket")) * F.col("total") / F.col("n")
    found = counts.select("bucket", rate.alias("rate"))
    found = found.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART).cast("long"), F.lit(1)))
    mean = F.col("rate") / F.col("parts")
    # each term is the one before times mean / k; the running sums are the steps of the distribution
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * mean / k)).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return found.withColumn("steps", steps)


def bucket_of(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.isin(*weights), source).otherwise(F.lit(OTHERS)) if weights else F.lit(OTHERS)


def copies(docs: DataFrame, weights: dict[str, float], seed: int = SEED, size: float | None = None) -> DataFrame:
    """(row, copy, shuffle_key): each row of docs, as a struct, as often as its Poisson count says.

    The count has the mean of the row's source and is found by inverting the distribution at a uniform hashed from
    doc_id and seed: the same on every run and after any lost task. copy counts from 1; shuffle_key is a hash of
    (doc_id, copy, seed).
    """
    table = rates(docs, weights, size)
    rows = boxed(docs, bucket=bucket_of(F.col("source"), weights), doc_id=F.col("doc_id"))

    def inverted(part: Column) -> Column:
        # the one-element array binds the uniform, which is then hashed once and not for each step
        once = F.array(uniform(F.col("doc_id"), F.lit(seed), part))
        return F.get(F.transform(once, lambda u: F.size(F.filter("steps", lambda c: c <= u)).cast("long")), F.lit(0))

    parts = F.sequence(F.lit(1).cast("long"), F.col("parts"))
    count = F.aggregate(parts, F.lit(0).cast("long"), lambda n, part: n + inverted(part))
    rows = rows.join(F.broadcast(table), "bucket").select("row", "doc_id", count.alias("n")).filter("n > 0")
    rows = rows.select("row", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return rows.select("row", "copy", uniform(F.col("doc_id"), F.col("copy"), F.lit(seed), F.lit("order")).alias("shuffle_key"))


def mix(docs: DataFrame, weights: dict[str, float], seed: int = SEED, size: float | None = None) -> DataFrame:
    """The mixture in the columns of docs, whatever their names, globally shuffled (see copies).

    Rows without source count as unnamed sources. Rows that repeat a doc_id (or have none) get equal counts. Null, empty
    and very long texts are mixed as they are; an empty table gives an empty mixture. The order is that of a hash, which
    deals hot sources over all partitions.
    """
    return copies(docs, weights, seed, size).orderBy("shuffle_key").select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents at WEIGHTS, in its shuffled order: doc_id, source, copy, shuffle_key, text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return copies(docs, WEIGHTS).orderBy("shuffle_key").select("row.doc_id", "row.source", "copy", "shuffle_key", "row.text")


def _uniform_sql(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(cast({p} as varchar), '~')" for p in parts)
    return f"(cast(('0x' || substr(md5({text}), 1, 13)) as bigint) / {float(1 << 52)!r})"


OP1_SQL = f"""
with shares(bucket, weight) as (values {", ".join(f"('{k}', cast({w!r} as double))" for k, w in WEIGHTS.items())},
    ('others', cast({max(0.0, 1.0 - sum(WEIGHTS.values()))!r} as double))),
bucketed as (
    select doc_id, source, text,
        case when source in ({", ".join(f"'{k}'" for k in WEIGHTS)}) then source else 'others' end as bucket
    from documents),
means as (
    select bucket, weight * cast((select count(*) from documents) as double) / n as rate,
        greatest(cast(ceil(weight * cast((select count(*) from documents) as double) / n / {PART!r}) as bigint), 1) as parts
    from (select bucket, count(*) as n from bucketed group by bucket) join shares using (bucket)),
steps as (
    with recursive terms(bucket, parts, mean, k, p, cdf) as (
        select bucket, parts, rate / parts, 0, exp(-(rate / parts)), exp(-(rate / parts)) from means
        union all
        select bucket, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) from terms where k < {TERMS})
    select bucket, parts, list(cdf order by k) as cdf from terms group by bucket, parts),
counted as (
    select doc_id, source, text,
        list_sum(list_transform(range(1, parts + 1), lambda i:
            len(list_filter(cdf, lambda c: c <= {_uniform_sql("doc_id", str(SEED), "i")})))) as copies
    from bucketed join steps using (bucket)),
copied as (select doc_id, source, text, unnest(range(1, cast(copies as bigint) + 1)) as copy from counted where copies > 0)
select doc_id, source, copy, {_uniform_sql("doc_id", "copy", str(SEED), "'order'")} as shuffle_key, text from copied
"""
