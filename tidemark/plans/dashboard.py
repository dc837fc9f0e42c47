"""Parameterised questions to the fact and the marts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, rounded, share
from tidemark.plans.marts import on_time, overall


@dataclass(frozen=True)
class Filters:
    """Order dates (inclusive), customer regions, and All, Prepaid or COD."""

    first: date
    last: date
    regions: tuple[str, ...]
    payment: str = "All"

    def apply(self, fact: DataFrame) -> DataFrame:
        return fact.filter(self.condition())

    def condition(self) -> Column:
        keep = F.col("order_date").between(F.lit(self.first), F.lit(self.last)) & F.col("customer_region").isin(*self.regions)
        if self.payment == "COD":
            keep = keep & (F.col("payment_method") == "COD")
        elif self.payment == "Prepaid":
            keep = keep & (F.col("payment_method") != "COD")
        return keep


def order_date_bounds(fact: DataFrame) -> DataFrame:
    return fact.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))


def distinct_regions(geography: DataFrame) -> DataFrame:
    return geography.select("region").distinct().orderBy("region")


def kpi_tiles(fact: DataFrame, filters: Filters) -> DataFrame:
    return filters.apply(fact).agg(
        F.count("*").alias("orders"),
        rounded(F.avg("approval_hours"), 4).alias("approval_h"),
        rounded(F.avg("delivery_days"), 4).alias("delivery_d"),
        rounded(on_time(), 6).alias("on_time"),
        rounded(share(F.col("is_rto")), 6).alias("rto"),
        F.sum("net_revenue").cast("decimal(38,2)").alias("net_revenue"),
    )


def weekly_trend(fact: DataFrame, filters: Filters, in_flight_days: int = 28) -> DataFrame:
    """Weeks; the on-time rate of the last four is null, as most of their orders are still under way.

    The newest day is that of all orders, so all are grouped by week, and only those within the filters are counted.
    """
    keep = filters.condition()
    rate = share(~F.col("is_late"), keep & F.col("is_delivered"))
    weeks = fact.groupBy(F.trunc("order_date", "week").alias("week")).agg(
        F.count_if(keep).alias("orders"), rate.alias("_rate"), F.avg(F.when(keep, F.col("approval_hours"))).alias("_hours"), F.max("order_date").alias("_last")
    )
    # one row a week
    weeks = weeks.withColumn("_newest", F.max("_last").over(Window.partitionBy())).filter("orders > 0")
    settled = F.col("week") <= F.date_sub("_newest", in_flight_days)
    return weeks.select("week", "orders", F.when(settled, rounded(F.col("_rate"), 6)).alias("on_time"), rounded(F.col("_hours"), 4).alias("approval_h"))


def state_health(fact: DataFrame, filters: Filters, least_orders: int = 30) -> DataFrame:
    rows = filters.apply(fact)
    states = rows.groupBy(F.col("customer_state").alias("state")).agg(
        F.count("*").alias("orders"), F.avg("delivery_days").alias("delivery_d"), on_time().alias("rate"),
        F.count_if(F.col("is_delivered") & ~F.col("is_late")).alias("_punctual"),
        F.count_if(F.col("is_delivered") & F.col("is_late").isNotNull()).alias("_judged"),
        F.avg("approval_hours").alias("approval_h"), F.avg("processing_hours").alias("processing_h"),
        (F.avg("transit_days") * 24).alias("transit_h"),
    )
    # the national rate is that of all states, small ones too
    states = states.withColumn("_rate", ratio(overall("_punctual"), overall("_judged")))
    health = F.when(F.col("rate") < F.col("_rate") - 0.10, "critical").when(F.col("rate") < F.col("_rate") - 0.03, "at risk").otherwise("healthy")
    return (
        states.filter(F.col("orders") >= least_orders)
        .select(
            "state", "orders", rounded(F.col("delivery_d"), 4).alias("delivery_d"), rounded(F.col("rate"), 6).alias("on_time"),
            *[rounded(F.col(c), 4).alias(c) for c in ("approval_h", "processing_h", "transit_h")], health.alias("health"),
        )
        .orderBy("on_time", "state")
    )


def slowest_states(fact: DataFrame, filters: Filters, k: int = 12) -> DataFrame:
    return state_health(fact, filters).filter("delivery_d is not null").orderBy(F.desc("delivery_d"), "state").limit(k)


def courier_periods(fact: DataFrame, filters: Filters) -> DataFrame:
    period = F.when(F.col("sale_event").isNull(), "Normal days").otherwise("Sale days")
    return (
        filters.apply(fact)
        .filter("shipped_at is not null")
        .groupBy("courier", period.alias("period"))
        .agg(rounded(on_time(), 6).alias("on_time"), rounded(F.avg("transit_days"), 4).alias("transit_d"), F.count("*").alias("orders"))
    )


def quality_between(quality: DataFrame, first: date, last: date) -> DataFrame:
    return quality.filter(F.col("extract_date").between(F.lit(first), F.lit(last))).orderBy("extract_date")


def latest_days(quality: DataFrame, days: int = 14) -> DataFrame:
    return quality.orderBy(F.desc("extract_date")).limit(days)
