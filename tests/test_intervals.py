import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators.intervals import interval_join, interval_totals

POINTS, PERIODS = "id long, at timestamp_ntz", "begins timestamp_ntz, ends timestamp_ntz, name string"


def given(seed):
    """Periods of a microsecond to years, overlapping, empty, turned round and without bounds; times before 1970, too."""
    draw, zero = random.Random(seed), datetime(1969, 12, 20)
    spot = lambda: zero + timedelta(seconds=draw.randrange(2_000_000))
    periods = []
    for n in range(150):
        start = draw.choice([spot(), spot(), None]) if n % 9 == 0 else spot()
        length = draw.choice([timedelta(microseconds=1), timedelta(seconds=draw.randrange(9)), timedelta(hours=draw.randrange(100)), timedelta(days=draw.randrange(2000)), timedelta(0), timedelta(hours=-3)])
        periods.append((start, None if n % 17 == 0 or start is None else start + length, f"p{n}"))
    points = [(i, draw.choice([spot(), None, periods[i % 150][0], periods[i % 150][1]])) for i in range(400)]
    return points, periods


@pytest.mark.parametrize("outer", [False, True])
def test_equals_all_pairs(spark, outer):
    points, periods = given(3)
    df = interval_join(spark.createDataFrame(points, POINTS).repartition(3), spark.createDataFrame(periods, PERIODS), "at", "begins", "ends", ["name"], outer)
    expected = []
    for i, at in points:
        met = [n for s, e, n in periods if at and s and e and s <= at < e]
        expected += [(i, n) for n in met] or ([(i, None)] if outer else [])
    assert sorted(((r["id"], r["name"]) for r in df.collect()), key=repr) == sorted(expected, key=repr)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_periods_take_few_bins(spark):
    """A century among seconds: nothing is exploded to days, and no periods leave no pairs."""
    periods = [(datetime(1950, 1, 1), datetime(2050, 1, 1), "century"), (datetime(2000, 1, 1), datetime(2000, 1, 1, 0, 0, 1), "second")]
    points = spark.createDataFrame([(1, datetime(2000, 1, 1)), (2, datetime(1999, 1, 1)), (3, datetime(2050, 1, 1))], POINTS)
    found = interval_join(points, spark.createDataFrame(periods, PERIODS), "at", "begins", "ends", ["name"])
    assert sorted((r["id"], r["name"]) for r in found.collect()) == [(1, "century"), (1, "second"), (2, "century")]
    none = spark.createDataFrame([], PERIODS)
    assert interval_join(points, none, "at", "begins", "ends", ["name"]).isEmpty()
    assert interval_join(points, none, "at", "begins", "ends", ["name"], outer=True).count() == 3


@pytest.mark.parametrize("sliced", [7, 100, 20_000])
def test_totals_equal_all_pairs(spark, sliced):
    """In one slice and in many; values may be null, times may repeat."""
    points, periods = given(5)
    values = [(s, e, None if n % 5 == 0 else n * 7919 % 1000 - 500) for n, (s, e, _) in enumerate(periods)]
    periods_df = spark.createDataFrame(values, "begins timestamp_ntz, ends timestamp_ntz, value long")
    df = interval_totals(spark.createDataFrame(points, POINTS), periods_df, "at", "begins", "ends", "value", sliced)
    expected = []
    for i, at in points:
        met = [v for s, e, v in values if at and s and e and s <= at < e]
        known = [v for v in met if v is not None]
        if met:
            expected.append((i, len(met), min(known, default=None), max(known, default=None)))
    assert sorted((r["id"], r["periods"], r["least"], r["most"]) for r in df.collect()) == sorted(expected)
    assert interval_totals(spark.createDataFrame(points, POINTS), periods_df.limit(0), "at", "begins", "ends", "value").isEmpty()


def test_totals_make_no_pairs(spark):
    """40000 points in 40000 overlapping periods: 8e8 pairs, which a join by pairs would have to make."""
    points = spark.range(40_000).selectExpr("id", "timestamp_seconds(id) as at")
    periods = spark.range(40_000).selectExpr("timestamp_seconds(id) as begins", "timestamp_seconds(100000 + id) as ends", "id as value")
    found = interval_totals(points, periods, "at", "begins", "ends", "value", 1_000)
    assert found.filter("periods = id + 1 and least = 0 and most = id").count() == 40_000
