"""Rolling statistics over a daily series."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rolling_zscore(day: str, value: str, days: int = 28) -> Column:
    """How far a row's value is from the mean of the rows before it, in their sample standard deviations; null where these
    are 0 or fewer than two rows come before.

    A daily series has one row a day, so the window's one partition stays small whatever the size of the feed.
    """
    before = Window.orderBy(day).rowsBetween(-days, -1)
    number = F.col(value).cast("double")
    return F.try_divide(number - F.avg(number).over(before), F.stddev_samp(number).over(before))
