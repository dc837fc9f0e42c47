"""How old feeds are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(feeds: dict[str, DataFrame], now: Column | None = None, warn: int = 1, error: int = 3) -> DataFrame:
    """(source, loaded, days, status) of each feed: its newest `_loaded_at`, its age in whole days, and whether that is `warn` or
    `error` days or more. now: a time, as F.current_timestamp(); the newest load of all feeds, if not given. A feed
    without rows is an error."""
    ages = reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("source"), F.max("_loaded_at").alias("loaded")) for name, df in feeds.items()])
    # one row a feed
    clock = F.max("loaded").over(Window.partitionBy()) if now is None else now.cast("timestamp_ntz")
    days = F.timestamp_diff("DAY", F.col("loaded"), clock).cast("long")
    status = F.when(days.isNull() | (days >= error), "error").when(days >= warn, "warn").otherwise("pass")
    return ages.select("source", "loaded", days.alias("days"), status.alias("status"))
