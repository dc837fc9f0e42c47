"""Point-in-time and calendar joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_in_time_join(facts: DataFrame, versions: DataFrame, key: str, at: Column, columns: list[str]) -> DataFrame:
    """Each fact with the version of its key that was valid at `at` (nulls if none was).

    The key is an equality, so Spark shuffles by it and tests the interval inside each key; nothing is broadcast unless
    Spark sees that it is small.
    """
    right = versions.select(F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *columns)
    met = (facts[key] == F.col("_key")) & (at >= F.col("_from")) & (at < F.col("_to"))
    return facts.join(right, met, "left").drop("_key", "_from", "_to")


def calendar_days(calendar: DataFrame) -> DataFrame:
    """One row per day of each period, so that a range join becomes an equality."""
    return calendar.select("*", F.explode(F.sequence("start_date", "end_date")).alias("calendar_day"))


def calendar_join(df: DataFrame, calendar: DataFrame, day: Column) -> DataFrame:
    """df with sale_event of the period that holds `day`. The calendar is configuration, some periods a year, and is broadcast by a
    hint: of rows that come from the driver Spark doesn't know how few they are, and would move df to its days."""
    days = calendar_days(calendar).select("calendar_day", "sale_event")
    return df.join(F.broadcast(days), day == F.col("calendar_day"), "left").drop("calendar_day")
