"""Per-order building blocks and the life cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import DELIVERED, OPEN, days_between, hours_between, long
from tidemark.operators.joins import calendar_join, point_in_time_join
from tidemark.operators.versions import scd2
from tidemark.session import unkept


@dataclass(frozen=True)
class Settings:
    approval_sla_hours: float = 24
    shipping: str = "49"
    free_shipping_from: str = "499"
    settled_days: int = 21
    tolerance: str = "0.01"


def customers_scd2(versions: DataFrame) -> DataFrame:
    return scd2(versions).select(
        "customer_sk", "customer_id", "state", "state_raw", "pincode", "signup_at", "valid_from", "valid_to", "is_current", "version_number"
    )


def distinct(column: str) -> Column:
    """How many values a group has, for groups as small as the lines of an order: two such counts need no second pass."""
    return long(F.size(F.collect_set(column)))


def items_by_order(items: DataFrame, products: DataFrame) -> DataFrame:
    """primary_category is that of the dearest line with a category; of equal amounts the first by name."""
    joined = items.join(products.select("product_id", "category"), "product_id", "left")
    by_amount = F.when(F.col("category").isNotNull(), F.struct(-F.col("line_amount"), F.col("category")))
    return joined.groupBy("order_id").agg(
        *_amounts(),
        distinct("category").alias("distinct_categories"),
        F.min(by_amount)["category"].alias("primary_category"),
        distinct("seller_id").alias("distinct_sellers"),
    )


def _amounts() -> list[Column]:
    return [
        F.count("*").alias("item_count"),
        long(F.sum("quantity")).alias("units"),
        F.sum("line_amount").cast("decimal(14,2)").alias("gross_merchandise_value"),
    ]


def amounts_by_order(items: DataFrame) -> DataFrame:
    """items_by_order for those who read no categories: where no product is listed twice, amounts are those of the lines, which then
    needn't move to their products and back."""
    grouped = items.groupBy("order_id").agg(*_amounts(), distinct("seller_id").alias("distinct_sellers"))
    named = [unkept("distinct_categories", "long"), unkept("primary_category", "string")]
    return grouped.select("order_id", "item_count", "units", "gross_merchandise_value", *named, "distinct_sellers")


def payments_by_order(payments: DataFrame) -> DataFrame:
    charge, refund = ~F.col("is_refund"), F.col("is_refund")
    money = "decimal(14,2)"
    return payments.groupBy("order_id").agg(
        F.sum(F.when(charge, F.col("amount"))).cast(money).alias("amount_charged"),
        (-F.coalesce(F.sum(F.when(refund, F.col("amount"))), F.lit(0))).cast(money).alias("amount_refunded"),
        F.sum("amount").cast(money).alias("net_amount"),
        F.min(F.when(charge, F.col("paid_at"))).alias("first_charged_at"),
        F.max(F.when(refund, F.col("paid_at"))).alias("refunded_at"),
        F.count("*").alias("payment_events"),
    )


#: What the life cycle takes of an order's latest version.
OF_LATEST = (
    "order_id", "customer_id", "hub_id", "courier", "payment_method", "order_status", "purchase_at", "approved_at", "shipped_at", "delivered_at",
    "closed_at", "estimated_delivery_date", "updated_at", "version_count", "had_late_arrival", "last_loaded_at",
)


def customers_at_purchase(latest: DataFrame, customers: DataFrame) -> DataFrame:
    """(order_id, customer_sk, customer_state) of the customer version valid at purchase: what moves is three columns of an order."""
    valid = customers.select("customer_id", "customer_sk", F.col("state").alias("customer_state"), "valid_from", "valid_to")
    found = point_in_time_join(
        latest.select("order_id", "customer_id", "purchase_at"), valid, "customer_id", F.col("purchase_at"), ["customer_sk", "customer_state"]
    )
    return found.select("order_id", "customer_sk", "customer_state")


def orders_lifecycle(
    latest: DataFrame,
    versions: DataFrame,
    customers: DataFrame,
    states: DataFrame,
    hubs: DataFrame,
    sales: DataFrame,
    raw_payments: DataFrame,
    settings: Settings = Settings(),
    also: tuple[str, ...] = (),
    by_order: bool = False,
    placed: DataFrame | None = None,
) -> DataFrame:
    """Latest orders (and their columns `also`) with the customer version valid at purchase, region, hub, sale, durations and service flags.

    `now` is the newest event in the feed. Orders and customer versions are joined on the customer; states, hubs and
    the sale calendar are seeds and broadcast by a hint: where they come from joins themselves, Spark takes the product of
    the sizes for theirs. `placed` has the customers_at_purchase, if they are known already.
    """
    now = F.broadcast(versions.agg(F.max("updated_at").alias("as_of_ts")))
    valid = customers.select("customer_id", "customer_sk", F.col("state").alias("customer_state"), "valid_from", "valid_to")
    # by order first, as the latest versions are dealt; then by customer
    paid = raw_payments.groupBy("order_id").agg(F.max("_loaded_at").alias("_paid"))
    latest = latest.join(paid, "order_id", "left")
    if placed is None:
        rows = point_in_time_join(latest, valid, "customer_id", F.col("purchase_at"), ["customer_sk", "customer_state"])
    else:
        rows = latest.join(placed, "order_id", "left")
    if by_order:  # dealt by order again before columns are added that can be worked out there
        rows = rows.repartition("order_id")
    places = states.select(F.col("state").alias("customer_state"), F.col("region").alias("customer_region"), "remoteness_tier")
    rows = rows.join(F.broadcast(places), "customer_state", "left")
    rows = rows.join(F.broadcast(hubs.select("hub_id", "hub_state", "hub_region")), "hub_id", "left")
    rows = calendar_join(rows, sales, F.col("purchase_at").cast("date"))
    rows = rows.join(now)
    status, arrived = F.col("order_status"), F.col("delivered_at")
    delivered_in_order = arrived >= F.col("shipped_at")
    approval = hours_between(F.col("purchase_at"), F.col("approved_at"))
    return rows.select(
        "order_id", "customer_id", "customer_sk", "customer_state", "customer_region", "remoteness_tier", "hub_id", "hub_state",
        "hub_region", "courier", "payment_method", status.alias("current_status"), "purchase_at", "approved_at", "shipped_at",
        "delivered_at", "closed_at", "estimated_delivery_date", F.col("updated_at").alias("last_status_change_at"),
        "version_count", "had_late_arrival", "sale_event",
        F.greatest("last_loaded_at", F.coalesce("_paid", "last_loaded_at")).alias("source_last_loaded_at"),
        "as_of_ts",
        (arrived.isNotNull() & (arrived < F.col("shipped_at"))).alias("has_timestamp_anomaly"),
        status.isin(*DELIVERED).alias("is_delivered"),
        (status == "cancelled").alias("is_cancelled"),
        (status == "returned").alias("is_returned"),
        (status == "rto").alias("is_rto"),
        status.isin(*OPEN).alias("is_open"),
        (F.col("customer_region") != F.col("hub_region")).alias("is_cross_region"),
        approval.alias("approval_hours"),
        hours_between(F.col("approved_at"), F.col("shipped_at")).alias("processing_hours"),
        F.when(delivered_in_order, days_between(F.col("shipped_at"), arrived)).alias("transit_days"),
        F.when(delivered_in_order, days_between(F.col("purchase_at"), arrived)).alias("delivery_days"),
        F.when(arrived.isNotNull(), arrived.cast("date") > F.col("estimated_delivery_date")).alias("is_late"),
        F.when(arrived.isNotNull(), F.greatest(F.datediff(arrived.cast("date"), "estimated_delivery_date"), F.lit(0)).cast("long")).alias("days_late"),
        (status.isin(*OPEN) & (F.col("as_of_ts").cast("date") > F.col("estimated_delivery_date"))).alias("is_open_and_overdue"),
        (approval > settings.approval_sla_hours).alias("breached_approval_sla"),
        *also,
    )
