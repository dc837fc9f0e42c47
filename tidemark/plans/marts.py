"""Service-level marts over the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import path_date, ratio, rounded, share
from tidemark.operators.joins import calendar_days
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.rolling import rolling_zscore


#: What marts that read the fact more than once take from it: a fact that is stored for them alone holds no more, and then the
#: joins that bring the rest (lines, payments) aren't planned at all. The columns that the contract guards are among them.
GUARDED = ("order_id", "current_status")
FACT_COLUMNS = {
    "fulfillment_daily": (
        "order_date", "customer_state", "customer_region", "sale_event", "is_delivered", "is_cancelled", "is_rto", "is_returned", "is_late",
        "approval_hours", "processing_hours", "delivery_days", "gross_merchandise_value", "net_revenue",
    ),
    "state_scorecard": (
        "customer_state", "customer_region", "remoteness_tier", "approval_hours", "processing_hours", "transit_days", "delivery_days",
        "is_delivered", "is_late", "is_cancelled", "is_rto", "is_returned", "is_cross_region", "gross_merchandise_value",
    ),
    "courier_performance": (
        "order_date", "courier", "customer_region", "sale_event", "shipped_at", "is_delivered", "is_rto", "transit_days", "is_late", "days_late",
    ),
    "order_funnel": ("approved_at", "shipped_at", "is_delivered", "is_returned", "is_cancelled", "is_rto", "order_date"),
}


def on_time() -> Column:
    return share(~F.col("is_late"), F.col("is_delivered"))


def mean(column: str, digits: int = 2) -> Column:
    return rounded(F.avg(F.col(column)), digits).alias(f"avg_{column}")


def with_quantiles(rows: DataFrame, groups: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """groups, one row per value of keys, with the quantiles of column (name: share) over rows, which should be stored."""
    found = exact_quantiles(rows, keys, column, shares)
    met = [F.col(f"g.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    return groups.alias("g").join(found.alias("q"), met, "left").select("g.*", *[rounded(F.col(n), 2).alias(n) for n in shares])


def total(column: str) -> Column:
    return F.sum(column).cast("decimal(38,2)")


def fulfillment_daily(fact: DataFrame) -> DataFrame:
    """fact should be stored."""
    delivered, keys = F.count_if("is_delivered"), ["order_date", "customer_state", "customer_region"]
    daily = fact.groupBy(*keys).agg(
        F.any_value("sale_event", True).alias("sale_event"),
        F.count("*").alias("orders"),
        delivered.alias("delivered_orders"),
        F.count_if("is_cancelled").alias("cancelled_orders"),
        F.count_if("is_rto").alias("rto_orders"),
        F.count_if("is_returned").alias("returned_orders"),
        F.count_if("is_late").alias("late_deliveries"),
        mean("approval_hours"),
        mean("processing_hours"),
        mean("delivery_days"),
        rounded(ratio(F.count_if(F.col("is_delivered") & ~F.col("is_late")), delivered), 4).alias("on_time_rate"),
        total("gross_merchandise_value").alias("gmv"),
        total("net_revenue").alias("net_revenue"),
    )
    return with_quantiles(fact, daily, keys, "delivery_days", {"p90_delivery_days": 0.9})


def state_scorecard(fact: DataFrame) -> DataFrame:
    """States against the national averages, which come from the states' own sums. Ranks and national sums run over one row
    per state; a state may have any number of orders. fact should be stored."""
    keys = ["state", "region", "remoteness_tier"]
    fact = fact.withColumnsRenamed({"customer_state": "state", "customer_region": "region"})
    by_state = fact.groupBy(*keys).agg(
        F.count("*").alias("orders"),
        *[mean(c) for c in ("approval_hours", "processing_hours", "transit_days", "delivery_days")],
        rounded(on_time(), 4).alias("on_time_rate"),
        rounded(share(F.col("is_cancelled")), 4).alias("cancellation_rate"),
        rounded(share(F.col("is_rto")), 4).alias("rto_rate"),
        rounded(share(F.col("is_returned"), F.col("is_delivered")), 4).alias("return_rate"),
        rounded(share(F.col("is_cross_region")), 4).alias("cross_region_share"),
        total("gross_merchandise_value").alias("gmv"),
        *parts("delivery_days"),
        F.count_if(F.col("is_delivered") & ~F.col("is_late")).alias("_punctual"),
        F.count_if(F.col("is_delivered") & F.col("is_late").isNotNull()).alias("_judged"),
    )
    by_state = with_quantiles(fact, by_state, keys, "delivery_days", {"p50_delivery_days": 0.5, "p90_delivery_days": 0.9})
    rate, national = F.col("on_time_rate"), ratio(overall("_punctual"), overall("_judged"))
    return by_state.withColumns(
        {
            "delivery_days_vs_national": rounded(F.col("avg_delivery_days") - overall_mean("delivery_days"), 2),
            "on_time_rate_vs_national": rounded(rate - national, 4),
            "on_time_rank": F.rank().over(Window.orderBy(F.desc_nulls_last("on_time_rate"))).cast("long"),
            "speed_rank": F.rank().over(Window.orderBy(F.asc_nulls_last("avg_delivery_days"))).cast("long"),
            "sla_health": F.when(rate < national - 0.10, "critical").when(rate < national - 0.03, "at risk").otherwise("healthy"),
        }
    ).drop("_punctual", "_judged", "_sum_delivery_days", "_n_delivery_days")


def parts(column: str) -> list[Column]:
    """The sum and the count of which group means and the overall mean are made."""
    return [F.sum(column).alias(f"_sum_{column}"), F.count(column).alias(f"_n_{column}")]


def overall(column: str) -> Column:
    """The sum over all groups, of which there are few."""
    return F.sum(column).over(Window.partitionBy())


def overall_mean(column: str) -> Column:
    return ratio(overall(f"_sum_{column}"), overall(f"_n_{column}"))


def group_mean(column: str) -> Column:
    return ratio(F.col(f"_sum_{column}"), F.col(f"_n_{column}"))


def courier_performance(fact: DataFrame) -> DataFrame:
    """fact should be stored."""
    keys = ["order_month", "courier", "customer_region", "is_sale_period"]
    shipped = fact.filter("shipped_at is not null").withColumns(
        {"order_month": F.trunc("order_date", "month"), "is_sale_period": F.col("sale_event").isNotNull()}
    )
    couriers = shipped.groupBy(*keys).agg(
        F.count("*").alias("shipments"),
        F.count_if("is_delivered").alias("delivered"),
        F.count_if("is_rto").alias("rto"),
        mean("transit_days"),
        F.count_if("is_late").alias("sla_breaches"),
        rounded(on_time(), 4).alias("on_time_rate"),
        rounded(F.avg(F.when(F.col("is_late"), F.col("days_late"))), 2).alias("avg_days_late_when_late"),
        rounded(share(F.col("is_rto")), 4).alias("rto_rate"),
    )
    return with_quantiles(shipped, couriers, keys, "transit_days", {"p90_transit_days": 0.9})


def stage_bottlenecks(fact: DataFrame) -> DataFrame:
    """Where each state loses its time; of equal excesses the earlier stage is named."""
    done = fact.filter("delivery_days is not null")
    means = {"approval": ("approval_hours", 1), "processing": ("processing_hours", 1), "transit": ("transit_days", 24)}
    by_state = done.groupBy(F.col("customer_state").alias("state"), F.col("customer_region").alias("region")).agg(
        F.count("*").alias("delivered_orders"), *[p for c, _ in means.values() for p in parts(c)]
    )
    both = [f(c) * hours for c, hours in means.values() for f in (group_mean, overall_mean)]
    by_state = by_state.select("state", "region", "delivered_orders", *[m.alias(n) for m, n in zip(both, [n for s in means for n in (s, f"_{s}")])])
    whole = F.col("approval") + F.col("processing") + F.col("transit")
    excess = {s: F.col(s) - F.col(f"_{s}") for s in means}
    worst = F.greatest(*excess.values())
    return by_state.select(
        "state",
        "region",
        "delivered_orders",
        *[rounded(F.col(s), 2).alias(f"avg_{s}_hours") for s in means],
        rounded(whole / 24, 2).alias("avg_total_days"),
        *[rounded(ratio(F.col(s), whole), 4).alias(f"{s}_share") for s in means],
        *[rounded(x, 2).alias(f"{s}_excess_hours") for s, x in excess.items()],
        F.when(excess["approval"] == worst, "approval")
        .when(excess["processing"] == worst, "warehouse processing")
        .otherwise("last-mile transit")
        .alias("bottleneck_stage"),
    )


def sale_event_impact(fact: DataFrame, sales: DataFrame, baseline_days: int = 28) -> DataFrame:
    """Each sale against the non-sale orders of the four weeks before it; sales without such orders are left out.

    Periods are widened by the baseline and exploded to days, so the range join is an equality with a small table. One
    pass: each figure is taken of the orders during the sale and of those before it, in one aggregate by sale.
    """
    widened = sales.select(
        F.col("sale_event").alias("event"), F.col("start_date").alias("first"), F.col("end_date").alias("last"),
        F.date_sub("start_date", baseline_days).alias("start_date"), "end_date",
    )
    days = calendar_days(widened).drop("start_date", "end_date")
    inside = F.col("order_date") >= F.col("first")
    rows = fact.join(days, F.col("order_date") == F.col("calendar_day")).filter(inside | F.col("sale_event").isNull()).withColumn("inside", inside)
    punctual = F.when(F.col("is_delivered"), (~F.col("is_late")).cast("double"))
    figures = {"approval": F.col("approval_hours"), "delivery": F.col("delivery_days"), "on_time": punctual}
    sides = {"": F.col("inside"), "b_": ~F.col("inside")}
    keys = ["event", "first", "last"]
    # days are counted after one more grouping, by day, so that no distinct aggregate doubles the rows
    daily = rows.groupBy(*keys, "inside", "order_date").agg(
        F.count("*").alias("orders"), *[F.sum(x).alias(f"sum_{n}") for n, x in figures.items()], *[F.count(x).alias(f"n_{n}") for n, x in figures.items()]
    )
    means = [ratio(F.sum(F.when(at, F.col(f"sum_{n}"))), F.sum(F.when(at, F.col(f"n_{n}")))).alias(f"{side}{n}") for side, at in sides.items() for n in figures]
    both = daily.groupBy(*keys).agg(
        F.sum(F.when(F.col("inside"), F.col("orders"))).alias("orders"), F.sum(F.when(~F.col("inside"), F.col("orders"))).alias("b_orders"), F.count_if(~F.col("inside")).alias("b_days"), *means
    ).filter("orders > 0 and b_orders > 0")
    event_days = F.datediff("last", "first") + 1
    per_day, before = ratio(F.col("orders"), event_days), ratio(F.col("b_orders"), F.col("b_days"))
    return both.select(
        F.col("event").alias("sale_event"),
        F.col("first").alias("start_date"),
        F.col("last").alias("end_date"),
        rounded(per_day, 1).alias("orders_per_day"),
        rounded(before, 1).alias("baseline_orders_per_day"),
        rounded(per_day / before, 2).alias("volume_uplift"),
        rounded(F.col("approval"), 2).alias("approval_hours"),
        rounded(F.col("approval") - F.col("b_approval"), 2).alias("approval_hours_delta"),
        rounded(F.col("delivery"), 2).alias("delivery_days"),
        rounded(F.col("delivery") - F.col("b_delivery"), 2).alias("delivery_days_delta"),
        rounded(F.col("on_time"), 4).alias("on_time_rate"),
        rounded(F.col("on_time") - F.col("b_on_time"), 4).alias("on_time_rate_delta"),
    )


def order_funnel(fact: DataFrame) -> DataFrame:
    placed, approved, shipped, delivered = F.count("*"), F.count("approved_at"), F.count("shipped_at"), F.count_if("is_delivered")
    kept = F.count_if(F.col("is_delivered") & ~F.col("is_returned"))
    return fact.groupBy(F.trunc("order_date", "month").alias("order_month")).agg(
        placed.alias("placed"),
        approved.alias("approved"),
        shipped.alias("shipped"),
        delivered.alias("delivered"),
        kept.alias("kept"),
        F.count_if("is_cancelled").alias("cancelled"),
        F.count_if("is_rto").alias("returned_to_origin"),
        rounded(ratio(approved, placed), 4).alias("approval_rate"),
        rounded(ratio(shipped, approved), 4).alias("ship_rate"),
        rounded(ratio(delivered, shipped), 4).alias("delivery_rate"),
        rounded(ratio(kept, placed), 4).alias("end_to_end_conversion"),
    )


def data_quality_daily(raw_orders: DataFrame, versions: DataFrame, latest: DataFrame) -> DataFrame:
    """An anomaly is an order whose latest version was delivered before it was shipped, on the day of its delivery; the fact
    isn't needed for that."""
    raw = raw_orders.groupBy(path_date(F.col("_source_file")).alias("extract_date")).agg(F.count("*").alias("raw_rows"))
    kept = versions.groupBy("extract_date").agg(
        F.count("*").alias("distinct_versions"),
        F.sum("duplicate_copies_dropped").cast("long").alias("duplicate_rows_dropped"),
        F.count_if("is_late_arrival").alias("late_arriving_versions"),
        F.max(F.datediff("extract_date", F.col("updated_at").cast("date"))).cast("long").alias("max_arrival_lag_days"),
    )
    skewed = latest.filter("delivered_at < shipped_at").groupBy(F.col("delivered_at").cast("date").alias("extract_date")).agg(
        F.count("*").alias("timestamp_anomalies")
    )
    none = F.lit(0).cast("long")
    joined = raw.join(kept, "extract_date", "left").join(skewed, "extract_date", "left")
    return joined.select(
        "extract_date",
        "raw_rows",
        "distinct_versions",
        *[F.coalesce(c, none).alias(c) for c in ("duplicate_rows_dropped", "late_arriving_versions")],
        rounded(ratio(F.coalesce("late_arriving_versions", none), F.col("distinct_versions")), 4).alias("late_arrival_rate"),
        *[F.coalesce(c, none).alias(c) for c in ("max_arrival_lag_days", "timestamp_anomalies")],
        rounded(rolling_zscore("extract_date", "raw_rows"), 2).alias("volume_zscore_28d"),
    )
