"""As-of join: each fact with the last version of its key that had begun by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialised


def asof_join(facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, columns: list[str], otherwise: dict[str, Column] | None = None) -> DataFrame:
    """facts with `columns` of the version of their key with the latest `since` that isn't after `at`.

    Where there is none (no version yet, no key, no time) a column is that of `otherwise`, an expression over the fact, or null.
    Versions without key or time never match; of versions with the same key and time the one with the largest `columns`
    counts, which must be orderable.

    Facts and versions go into one table that is dealt by ranges of (key, time) and sorted once; in this order each fact takes
    the last version before it. No pair of a key's facts and versions is looked at, and a key of any size is spread over as
    many ranges as it fills, as facts of one time are, too. A range goes on with at most one key of the range before, so
    the versions that are carried from range to range are no more than there are ranges.
    """
    none = F.lit(None)
    value = F.struct(*[F.col(c) for c in columns])
    kind = versions.select(value.alias("v")).schema["v"].dataType
    fact = facts.select(F.struct(*[F.col(c) for c in facts.columns]).alias("_f"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_kind"), none.cast(kind).alias("_v"))
    fact = fact.withColumn("_salt", F.xxhash64("_f"))
    known = versions.filter(F.col(key).isNotNull() & F.col(since).isNotNull())
    version = known.select(
        none.cast(fact.schema["_f"].dataType).alias("_f"), F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_kind"), value.alias("_v"), F.lit(0).cast("long").alias("_salt")
    )
    dealt = fact.unionByName(version).repartitionByRange("_k", "_t", "_kind", "_salt").withColumn("_part", F.spark_partition_id())
    dealt = materialised(dealt)  # ranges are sampled, so their numbers hold for one run only
    before = Window.partitionBy("_k", "_part").orderBy("_t", "_kind", "_v", "_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max(F.when(F.col("_kind") == 0, F.struct("_t", "_v")))
    earlier = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("_k", "_part").agg(latest.alias("_end")).withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)["_v"])
    carried = ends.filter("_carried is not null").select("_k", "_part", "_carried")
    found = dealt.withColumn("_last", F.last("_v", ignorenulls=True).over(before)).filter("_kind = 1")
    found = found.join(F.broadcast(carried), ["_k", "_part"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    more = {c: F.col(f"_last.{c}") for c in columns}
    out = found.select("_f.*", F.col("_last").isNotNull().alias("_met"), *[x.alias(f"_new_{c}") for c, x in more.items()])
    chosen = [F.when(F.col("_met"), F.col(f"_new_{c}")).otherwise((otherwise or {}).get(c, none)).alias(c) for c in columns]
    return out.select(*facts.columns, *chosen)
