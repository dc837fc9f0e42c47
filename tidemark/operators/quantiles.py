"""Exact, interpolated quantiles of groups of any size and number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialised

#: Rows of a bin that are sorted together, and parts into which a larger one is divided.
SORTED, PARTS = 50_000, 1024


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def exact_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float], sorted_rows: int = SORTED) -> DataFrame:
    """keys and a column for each of `shares` (name: share): the quantile of the values, between its two neighbours in
    proportion. Nulls and NaN count as no values, infinite ones as the largest and smallest double; groups without values
    are left out; keys may be null.

    A percentile aggregate holds all distinct values of a group in one task. Here a group with more than `sorted_rows` values is
    divided into bins between its least and largest value; only the bins in which a wanted rank falls are divided again, each
    between the least and largest value that it really has, until a bin has few values or a single one. Then the values of these
    bins, and of all small groups, are ranked. df is read once for each round, so it should be stored; with small
    groups alone there is one round.
    """
    far = 1.7976931348623157e308
    number = F.greatest(F.least(F.col(column).cast("double"), F.lit(far)), F.lit(-far))
    rows = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*keys, number.alias("_value"))
    wanted = [r for p in shares.values() for r in (F.floor((F.col("_total") - 1) * F.lit(p)), F.ceil((F.col("_total") - 1) * F.lit(p)))]
    holds = reduce(lambda a, b: a | b, [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_n")) for r in wanted])
    shape = ["_lo", "_hi", "_n", "_before", "_total"]
    low, high = F.min("_value").alias("_lo"), F.max("_value").alias("_hi")
    groups = rows.groupBy(*keys).agg(low, high, F.count("*").alias("_n"))
    groups = materialised(groups.select(*keys, "_lo", "_hi", "_n", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_total")))
    settled = (F.col("_n") <= sorted_rows) | (F.col("_lo") == F.col("_hi"))
    done, open_ = groups.filter(settled), groups.filter(~settled)
    while not open_.isEmpty():
        # the rows of these bins alone, each dealt to its part; halves are subtracted, so that no difference overflows
        inside = (F.col("_value") >= F.col("_lo")) & (F.col("_value") <= F.col("_hi"))
        share = (F.col("_value") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        among = rows.alias("l").join(open_.alias("r"), _same("l", "r", keys) & inside)
        among = among.select(*[F.col(f"l.{k}") for k in keys], F.col("_lo").alias("_from"), F.col("_before").alias("_past"), "_total", "_value", F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).alias("_part"))
        bins = among.groupBy(*keys, "_from", "_past", "_total", "_part").agg(low, high, F.count("*").alias("_n"))
        upto = Window.partitionBy(*keys, "_from").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_before", F.col("_past") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        bins = materialised(bins.filter(holds).select(*keys, *shape))
        done, open_ = done.unionByName(bins.filter(settled)), bins.filter(~settled)
    # a bin of one value needs no rows; of others, all values are ranked
    single = done.filter("_lo = _hi").select(*keys, "_total", F.col("_lo").alias("_value"), F.col("_before").alias("_from"), (F.col("_before") + F.col("_n") - 1).alias("_to"))
    many = done.filter("_lo < _hi")
    inside = (F.col("_value") >= F.col("_lo")) & (F.col("_value") <= F.col("_hi"))
    picked = rows.alias("l").join(many.alias("r"), _same("l", "r", keys) & inside)
    picked = picked.select(*[F.col(f"l.{k}") for k in keys], "_total", "_lo", "_before", "_value")
    rank = F.row_number().over(Window.partitionBy(*keys, "_lo").orderBy("_value")) - 1 + F.col("_before")
    ranked = picked.withColumn("_from", rank.cast("long")).filter(reduce(lambda a, b: a | b, [F.col("_from") == r for r in wanted]))
    every = ranked.select(*keys, "_total", "_value", "_from", F.col("_from").alias("_to")).unionByName(single)
    at = lambda r: F.min(F.when((F.col("_from") <= r) & (r <= F.col("_to")), F.col("_value")))
    place = {name: (F.col("_total") - 1) * F.lit(p) for name, p in shares.items()}
    ends = [f.alias(f"_{name}_{side}") for name, p in place.items() for side, f in (("low", at(F.floor(p))), ("high", at(F.ceil(p))))]
    found = every.groupBy(*keys, "_total").agg(*ends)
    part = {name: p - F.floor(p) for name, p in place.items()}
    return found.select(*keys, *[(F.col(f"_{n}_low") * (1 - d) + F.col(f"_{n}_high") * d).alias(n) for n, d in part.items()])
