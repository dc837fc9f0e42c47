"""Interval join: points with all the periods that hold them, periods of any length that may overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialised

#: Bins that a period is entered in at most, at the level that is chosen for it.
SPREAD = 4


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def interval_join(points: DataFrame, periods: DataFrame, at: str, start: str, end: str, columns: list[str], outer: bool = False) -> DataFrame:
    """points with `columns` of each period with start <= at < end, one row for each pair (with outer: and points without any).

    Bounds and points are timestamps. Periods without start, without end or with an end not after their start hold nothing; points
    without time meet none. Columns of points and `columns` should differ.

    A period is entered in the bins of the narrowest level in which it takes SPREAD bins or fewer; bins of a level are four times
    as wide as those of the level below. A point is looked up in its one bin of each level that has periods, so a pair meets
    in one bin only, whether periods last for seconds or years: bins and entries don't grow with their length, and
    the test of the bounds passes a share of what meets that doesn't shrink with it either. The levels are few (log4 of the
    longest period); how many points fall in one bin doesn't matter, as Spark splits such partitions of an equality join.
    """
    base = 1_000_000  # a second
    held = periods.select(_micros(F.col(start)).alias("_s"), _micros(F.col(end)).alias("_e"), *columns).filter("_s < _e")
    # the level whose SPREAD - 1 bins are as wide as the period; one more bin for its offset
    level = F.greatest(F.ceil(F.log2((F.col("_e") - F.col("_s")) / F.lit(float(base * (SPREAD - 1)))) / 2), F.lit(0)).cast("int")
    width = F.lit(base) * F.pow(F.lit(4.0), F.col("_level")).cast("long")
    held = materialised(held.withColumn("_level", level).withColumn("_width", width))
    levels = sorted((r["_level"], r["_width"]) for r in held.select("_level", "_width").distinct().collect())
    bins = F.sequence(F.expr("_s div _width - if(_s < 0 and _s % _width <> 0, 1, 0)"), F.expr("(_e - 1) div _width - if(_e - 1 < 0 and (_e - 1) % _width <> 0, 1, 0)"))
    entered = held.withColumn("_bin", F.explode(bins)).drop("_width")
    keyed = points.select(F.struct(*[F.col(c) for c in points.columns]).alias("_p"), _micros(F.col(at)).alias("_t"))
    looked = F.array(*[F.struct(F.lit(n).cast("int").alias("_level"), F.floor(F.expr(f"(_t - pmod(_t, {w})) div {w}")).cast("long").alias("_bin")) for n, w in levels])
    if not levels:
        looked = F.array(F.struct(F.lit(-1).alias("_level"), F.lit(0).cast("long").alias("_bin")))
    if not outer:
        spots = keyed.withColumn("_l", F.explode(looked)).select("_p", "_t", "_l._level", "_l._bin")
        met = spots.join(entered, ["_level", "_bin"]).filter("_s <= _t and _t < _e")
        return met.select("_p.*", *columns)
    # a point without periods is kept by its lowest level, if no level has a match: told by counting per point what met
    spots = keyed.withColumn("_id", F.monotonically_increasing_id())
    spots = materialised(spots)
    each = spots.withColumn("_l", F.explode(looked)).select("_id", "_t", "_l._level", "_l._bin")
    met = each.join(entered, ["_level", "_bin"]).filter("_s <= _t and _t < _e").select("_id", *columns)
    return spots.join(met, "_id", "left").select("_p.*", *columns)


#: Distinct times of a slice that interval_totals aims at, and slices at most (their bounds are one array).
SLICE, SLICES = 20_000, 2_048
_PART = "_slice int, _kind int, _a long, _b long, _n long, _v long, _least long, _most long"
_FAR = np.iinfo("int64")


def _covered(size: int, first: np.ndarray, last: np.ndarray, value: np.ndarray, least: bool) -> np.ndarray:
    """The least (else largest) value of the ranges [first, last) that hold each of `size` places; _FAR where none does.

    A range is two overlapping ones of a power of two, which are handed down half by half: size log size steps, not one for
    each place of each range.
    """
    better, none = (np.minimum, _FAR.max) if least else (np.maximum, _FAR.min)
    rank = np.frexp((last - first).astype("float64"))[1] - 1  # floor(log2(length))
    table = np.full(size, none, dtype="int64")
    for k in range(int(rank.max()) if len(rank) else 0, -1, -1):
        here = rank == k
        better.at(table, first[here], value[here])
        better.at(table, last[here] - (1 << k), value[here])
        if k:
            half = table.copy()
            half[1 << (k - 1) :] = better(half[1 << (k - 1) :], table[: size - (1 << (k - 1))])
            table = half
    return table


def _summed(size: int, first: np.ndarray, last: np.ndarray, count: np.ndarray) -> np.ndarray:
    steps = np.zeros(size + 1, dtype="int64")
    np.add.at(steps, first, count)
    np.add.at(steps, last, -count)
    return np.cumsum(steps)[:size]


def _totals(size: int, first: np.ndarray, last: np.ndarray, rows: pd.DataFrame) -> dict[str, np.ndarray]:
    full = last > first
    first, last, rows = first[full], last[full], rows[full]
    known = (rows["_v"] > 0).to_numpy()
    extreme = {c: _covered(size, first[known], last[known], rows[c].to_numpy()[known], c == "_least") for c in ("_least", "_most")}
    return {c: _summed(size, first, last, rows[c].to_numpy()) for c in ("_n", "_v")} | extreme


def _whole_slices(size: int):
    """The totals of the periods that hold a whole slice, for each of `size` slices: rows are no more than slices squared in
    pairs of bounds, and mostly far fewer."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _totals(size, rows["_from"].to_numpy(), rows["_upto"].to_numpy(), rows)
        zero = np.zeros(size, dtype="int64")
        return pd.DataFrame({"_slice": np.arange(size, dtype="int32"), "_kind": zero.astype("int32") + 2, "_a": zero, "_b": zero, **found})

    return run


def _one_slice(rows: pd.DataFrame) -> pd.DataFrame:
    kind = rows["_kind"].to_numpy()
    times = np.sort(rows["_a"].to_numpy()[kind == 0])
    parts, whole = rows[kind == 1], rows[kind == 2]
    first, last = np.searchsorted(times, parts["_a"].to_numpy()), np.searchsorted(times, parts["_b"].to_numpy())
    found = _totals(len(times), first, last, parts)
    for r in whole.itertuples(index=False):
        found["_n"], found["_v"] = found["_n"] + r[4], found["_v"] + r[5]
        found["_least"], found["_most"] = np.minimum(found["_least"], r[6]), np.maximum(found["_most"], r[7])
    out = pd.DataFrame({"_t": times, **found})
    return out[out["_n"] > 0]


def interval_totals(points: DataFrame, periods: DataFrame, at: str, start: str, end: str, value: str, sliced: int = SLICE) -> DataFrame:
    """points that any period with start <= at < end holds, with `periods` (how many do), `least` and `most` (of their `value`, a
    long; null if all are null): what grouping interval_join by point gives, without a row for each pair.

    Pairs grow with the square of the input where periods overlap much, so none is made. Time is divided into slices of about
    `sliced` distinct times. A period is known to the slices of its two ends alone, where parts with the same bounds are one row;
    those that hold a slice as a whole are put together by the slices they reach. Each slice then works out the totals of its
    distinct times in n log n steps.
    """
    keyed = points.withColumn("_t", _micros(F.col(at)))
    numbers = [F.count("*").alias("_n"), F.count(value).alias("_v"), F.coalesce(F.min(value), F.lit(int(_FAR.max))).alias("_least"), F.coalesce(F.max(value), F.lit(int(_FAR.min))).alias("_most")]
    held = periods.select(_micros(F.col(start)).alias("_s"), _micros(F.col(end)).alias("_e"), F.col(value).cast("long").alias(value)).filter("_s < _e")
    held = materialised(held.groupBy("_s", "_e").agg(*numbers))
    times = materialised(keyed.filter("_t is not null").select("_t").distinct())
    every = times.unionByName(held.select(F.explode(F.array("_s", "_e")).alias("_t")))
    number = min(SLICES, every.count() // sliced + 1)
    cuts = every.agg(F.percentile_approx("_t", [i / number for i in range(1, number)], 10 * SLICES)).first()[0] if number > 1 else None
    cuts = np.unique(np.array(cuts or [], dtype="int64"))

    @F.pandas_udf("int")
    def slice_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right"))

    zero, both = F.lit(0).cast("long"), ["_n", "_v", "_least", "_most"]
    spots = times.select(slice_of("_t").alias("_slice"), F.lit(0).alias("_kind"), F.col("_t").alias("_a"), zero.alias("_b"), *[zero.alias(c) for c in both])
    placed = materialised(held.withColumns({"_x": slice_of("_s"), "_y": slice_of(F.col("_e") - 1)}))
    early, late = F.lit(int(_FAR.min)), F.lit(int(_FAR.max))
    inner = F.array(F.struct(F.col("_x").alias("_slice"), F.col("_s").alias("_a"), F.col("_e").alias("_b")))
    outer = F.array(F.struct(F.col("_x").alias("_slice"), F.col("_s").alias("_a"), late.alias("_b")), F.struct(F.col("_y").alias("_slice"), early.alias("_a"), F.col("_e").alias("_b")))
    again = [F.sum("_n").alias("_n"), F.sum("_v").alias("_v"), F.min("_least").alias("_least"), F.max("_most").alias("_most")]
    ends = placed.withColumn("_p", F.explode(F.when(F.col("_x") == F.col("_y"), inner).otherwise(outer)))
    parts = ends.groupBy("_p._slice", "_p._a", "_p._b").agg(*again).select("_slice", F.lit(1).alias("_kind"), "_a", "_b", *both)
    spans = placed.filter("_y > _x + 1").groupBy((F.col("_x") + 1).alias("_from"), F.col("_y").alias("_upto")).agg(*again)
    whole = spans.groupBy().applyInPandas(_whole_slices(len(cuts) + 1), _PART)
    found = spots.unionByName(parts).unionByName(whole).groupBy("_slice").applyInPandas(_one_slice, "_t long, _n long, _v long, _least long, _most long")
    seen = lambda c: F.when(F.col("_v") > 0, F.col(c))
    found = found.select("_t", F.col("_n").alias("periods"), seen("_least").alias("least"), seen("_most").alias("most"))
    return keyed.join(found, "_t").drop("_t")
