"""Data-quality assertions. Each returns the violating rows: none means that the data pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return unique_combination(df.filter(F.col(column).isNotNull()), [column])


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def relationships(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose non-null key is missing in the other table."""
    keys = other.select(F.col(other_column).alias("_key"))
    return df.filter(F.col(column).isNotNull()).join(keys, df[column] == keys["_key"], "left_anti")


def one_current_row_per_key(df: DataFrame, key: str, flag: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_if(flag).alias("current_rows")).filter("current_rows <> 1")


def positive_value(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) <= 0)


def value_between(df: DataFrame, column: str, least=None, most=None) -> DataFrame:
    """Either bound may be left out; nulls pass."""
    wrong = F.lit(False)
    if least is not None:
        wrong = wrong | (F.col(column) < least)
    if most is not None:
        wrong = wrong | (F.col(column) > most)
    return df.filter(wrong)


def timestamps_in_order(df: DataFrame, earlier: str, later: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.filter(F.col(later) < F.col(earlier))


def scd2_no_overlaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that are empty, overlap the next one of their key or leave a gap before it."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    rows = df.select(key, start, end, following.alias("next_from"))
    return rows.filter((F.col(end) <= F.col(start)) | (F.col("next_from") != F.col(end)))


def missing(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Distinct keys of source that don't reach target. They are made distinct before they move."""
    keys, reached = source.select(key).distinct(), target.select(F.col(key).alias("_reached"))
    return keys.join(reached, F.col(key).eqNullSafe(F.col("_reached")), "left_anti")
