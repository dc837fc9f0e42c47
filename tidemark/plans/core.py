"""The star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import long
from tidemark.operators.joins import calendar_join
from tidemark.plans.staging import item_id, line_amount
from tidemark.schemas import FACT, conform


def fct_orders(lifecycle: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per order, in the fact's contract."""
    return in_contract(lifecycle.join(items, "order_id", "left").join(payments, "order_id", "left"))


def in_contract(joined: DataFrame) -> DataFrame:
    """Money without payments is 0; item columns without items stay null."""
    zero = F.lit(0).cast("decimal(14,2)")
    made = {
        "order_date_key": F.date_format("purchase_at", "yyyyMMdd").cast("int"),
        "order_date": F.col("purchase_at").cast("date"),
        "amount_charged": F.coalesce("amount_charged", zero),
        "amount_refunded": F.coalesce("amount_refunded", zero),
        "net_revenue": F.coalesce("net_amount", zero),
    }
    return conform(joined.withColumns(made).select([f.name for f in FACT]), FACT)


def dim_geography(states: DataFrame) -> DataFrame:
    tier = F.col("remoteness_tier")
    # The labels of the tiers
    label = F.when(tier == 1, "Metro / well connected").when(tier == 2, "Standard").otherwise("Remote")
    return states.select("state", "state_code", "region", "remoteness_tier", label.alias("remoteness_label"))


def dim_customers(customers: DataFrame, geography: DataFrame) -> DataFrame:
    places = geography.select("state", "region", "remoteness_tier")
    return customers.join(places, "state", "left").select(
        "customer_sk", "customer_id", "state", "region", "remoteness_tier", "state_raw", "pincode", "signup_at", "valid_from",
        "valid_to", "is_current", "version_number",
    )


def dim_hubs(hubs: DataFrame, sellers: DataFrame) -> DataFrame:
    counts = sellers.groupBy("hub_id").agg(F.count("seller_id").alias("_n"))
    return hubs.join(counts, "hub_id", "left").select(
        "hub_id", "hub_state", "hub_region", long(F.coalesce("_n", F.lit(0))).alias("seller_count")
    )


def dim_products(products: DataFrame, sellers: DataFrame) -> DataFrame:
    joined = products.join(sellers.select("seller_id", "seller_name", "hub_id"), "seller_id", "left")
    return joined.select("product_id", "category", "list_price", "weight_kg", "seller_id", "seller_name", "hub_id")


def dim_date(versions: DataFrame, sales: DataFrame, days_after: int = 60) -> DataFrame:
    """One row per day from the first purchase to some days after the last."""
    bounds = versions.agg(
        F.min("purchase_at").cast("date").alias("a"), F.date_add(F.max("purchase_at").cast("date"), days_after).alias("b")
    )
    days = bounds.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("date_day"))
    d = F.col("date_day")
    start = F.when(F.month(d) >= 4, F.year(d)).otherwise(F.year(d) - 1)
    return calendar_join(days, sales, d).select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d,
        long(F.year(d)).alias("calendar_year"),
        long(F.quarter(d)).alias("calendar_quarter"),
        long(F.month(d)).alias("month_number"),
        F.date_format(d, "MMM").alias("month_name"),
        F.trunc(d, "month").alias("month_start"),
        F.trunc(d, "week").alias("week_start"),
        long(F.weekday(d) + 1).alias("iso_day_of_week"),
        F.date_format(d, "E").alias("day_name"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        long(start).alias("fiscal_year_start"),
        F.concat(F.lit("FY"), F.right((start + 1).cast("string"), F.lit(2))).alias("fiscal_year"),
        "sale_event",
        F.col("sale_event").isNotNull().alias("is_sale_day"),
    )


def fct_order_items(items: DataFrame, fact: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of orders in the fact; others are dropped. Lines move to their products, so what can be worked out of their other
    columns is, after that."""
    orders = fact.select("order_id", "order_date_key", "customer_sk", "current_status", "is_returned")
    lines = items.select("order_id", "order_item_seq", "product_id", "seller_id", "quantity", "unit_price")
    joined = lines.join(orders, "order_id").join(products.select("product_id", "category", "hub_id"), "product_id", "left")
    return joined.select(
        item_id().alias("order_item_id"), "order_id", "order_item_seq", "order_date_key", "customer_sk", "product_id", "category", "seller_id",
        "hub_id", "quantity", "unit_price", line_amount().alias("line_amount"), "current_status", "is_returned",
    )


def fct_order_status_history(history: DataFrame, fact: DataFrame) -> DataFrame:
    return history.join(fact.select("order_id", "customer_state", "courier", "sale_event"), "order_id").select(
        "order_version_id", "order_id", "status_sequence", "previous_status", "order_status", "valid_from", "valid_to", "is_current",
        "hours_in_status", "customer_state", "courier", "sale_event",
    )
