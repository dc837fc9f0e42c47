"""Change-log operators: deduplication, latest version, history, slowly changing dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import hours_between, long, surrogate_key

FOREVER = "9999-12-31 00:00:00"


def keep_one(df: DataFrame, keys: list[str], order: list[Column], copies: str | None = None) -> DataFrame:
    """The first row of each key by `order`; with `copies`, a column of that name has how many rows the key had.

    Without copies Spark limits each key to one row before the shuffle (WindowGroupLimit). The count goes by the same sort
    as the rank.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if copies:
        df = df.withColumn(copies, F.count("*").over(_whole(w)))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def latest_version(versions: DataFrame, key: str = "order_id") -> DataFrame:
    """The row of each key with the latest event time (then the furthest status), with version_count, last_loaded_at
    and had_late_arrival over all of the key's versions. When rows arrived doesn't matter.

    The last row in ascending order is kept, so that versions in this order (as staging leaves them) aren't sorted again."""
    every = _whole(Window.partitionBy(key).orderBy("updated_at", "status_precedence"))
    counted = versions.withColumns(
        {
            "version_count": F.count("*").over(every),
            "last_loaded_at": F.max("_loaded_at").over(every),
            "had_late_arrival": F.bool_or("is_late_arrival").over(every),
            "_last": is_last(key),
        }
    )
    return counted.filter("_last").drop("_last")


def is_last(key: str = "order_id") -> Column:
    """Whether a version is the one that latest_version keeps."""
    return F.lead(F.lit(True)).over(Window.partitionBy(key).orderBy("updated_at", "status_precedence")).isNull()


def status_history(versions: DataFrame) -> DataFrame:
    """Half-open intervals of each order's statuses; valid_to is null for the current one."""
    return versions.select("order_version_id", "order_id", "order_status", *[c.alias(n) for n, c in history_columns().items()])


def history_columns() -> dict[str, Column]:
    """What status_history adds to versions."""
    w = Window.partitionBy("order_id").orderBy("updated_at", "status_precedence")
    following = F.lead("updated_at").over(w)
    return {
        "valid_from": F.col("updated_at"),
        "valid_to": following,
        "is_current": following.isNull(),
        "previous_status": F.lag("order_status").over(w),
        "hours_in_status": hours_between(F.col("updated_at"), following),
        "status_sequence": long(F.row_number().over(w)),
    }


def scd2(versions: DataFrame, key: str = "customer_id", at: str = "updated_at", sk: str = "customer_sk") -> DataFrame:
    """versions with a surrogate key and half-open validity intervals; the current version ends in the year 9999."""
    w = Window.partitionBy(key).orderBy(at)
    following = F.lead(at).over(w)
    return versions.withColumns(
        {
            sk: surrogate_key(F.col(key), F.col(at)),
            "valid_from": F.col(at),
            "valid_to": F.coalesce(following, F.lit(FOREVER).cast("timestamp_ntz")),
            "is_current": following.isNull(),
            "version_number": long(F.row_number().over(w)),
        }
    )
