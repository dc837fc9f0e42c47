"""Small reference tables. All are configuration of a fixed size, so they may be broadcast."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

#: The sales of a year, as (name, month, day, days): an invented calendar of periods that don't overlap.
SALES = (
    ("Clearance Week", 2, 9, 7),
    ("Spring Fair", 4, 17, 6),
    ("Midyear Days", 6, 20, 11),
    ("Harvest Sale", 9, 12, 8),
    ("Year-End Rush", 12, 15, 14),
)
YEARS = (*range(1995, 2003), 2024)
HUBS = 7
METHODS = ("UPI", "COD", "Credit Card", "Debit Card", "Wallet", "Net Banking")


def sale_periods(years: tuple[int, ...] = YEARS) -> list[tuple[str, date, date]]:
    return [
        (name, start, start + timedelta(days - 1))
        for year in years
        for name, month, day, days in SALES
        for start in [date(year, month, day)]
    ]


def sale_calendar(spark: SparkSession, years: tuple[int, ...] = YEARS) -> DataFrame:
    return spark.createDataFrame(sale_periods(years), "sale_event string, start_date date, end_date date")
