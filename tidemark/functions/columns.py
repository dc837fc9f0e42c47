"""Column functions shared by the models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of the life-cycle states; cancelled and rto rank the same.
STATUS_RANK = {"created": 1, "approved": 2, "shipped": 3, "delivered": 4, "cancelled": 5, "rto": 5, "returned": 6}
DELIVERED, OPEN = ("delivered", "returned"), ("created", "approved", "shipped")


def status_rank(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, status), F.lit(0))


def _micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def hours_between(start: Column, end: Column) -> Column:
    return _micros(start, end) / F.lit(3.6e9)


def days_between(start: Column, end: Column) -> Column:
    return _micros(start, end) / F.lit(8.64e10)


def path_date(path: Column) -> Column:
    """The date of a dt=YYYY-MM-DD part of a path, null without one."""
    return F.nullif(F.regexp_extract(path, r"dt=(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date")


def surrogate_key(*parts: Column) -> Column:
    """MD5 of the parts joined by |; null if any part is."""
    pieces = [x for p in parts for x in (F.lit("|"), p.cast("string"))][1:]
    return F.md5(F.concat(*pieces))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, of the value to twelve digits: the noise of binary fractions and of the order of additions lies
    below these and decides no tie. There is no negative zero."""
    return F.round(x.cast("decimal(38,12)"), digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(flag: Column, among: Column | None = None) -> Column:
    """Mean of a flag as 0 or 1, over the rows where `among` holds; nulls are skipped."""
    number = flag.cast("int").cast("double")
    return F.avg(number if among is None else F.when(among, number))


def long(x: Column) -> Column:
    return x.cast("long")
