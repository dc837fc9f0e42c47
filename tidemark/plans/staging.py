"""Typed, deduplicated feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import long, path_date, status_rank, surrogate_key
from tidemark.operators.versions import keep_one


def orders_cdc(orders: DataFrame) -> DataFrame:
    """One row per order version; of copies that were sent again the one loaded first stays.

    Rows are dealt by order, which suits this step and all that follow by order: the versions move once. They are sorted once,
    too: the precedence, which the status decides, stands among the keys so that versions leave in the order of their history.
    """
    ranked = orders.repartition("order_id").withColumn("status_precedence", status_rank(F.col("order_status")))
    keys = ["order_id", "updated_at", "status_precedence", "order_status"]
    kept = keep_one(ranked, keys, [F.col("_loaded_at"), F.col("_source_file")], copies="_copies")
    extracted = path_date(F.col("_source_file"))
    return kept.select(
        surrogate_key(F.col("order_id"), F.col("order_status"), F.col("updated_at")).alias("order_version_id"),
        "order_id", "customer_id", "hub_id", "courier", "payment_method", "order_status",
        "status_precedence",
        "purchase_at", "approved_at", "shipped_at", "delivered_at", "closed_at", "estimated_delivery_date", "updated_at",
        extracted.alias("extract_date"),
        (extracted > F.col("updated_at").cast("date")).alias("is_late_arrival"),
        long(F.col("_copies") - 1).alias("duplicate_copies_dropped"),
        "_source_file", "_loaded_at",
    )


def customers_cdc(customers: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per customer version; of copies the one loaded last stays. Free-text states become canonical ones, or
    null where no alias fits. Aliases are a seed of a size that Spark sees and broadcasts."""
    kept = keep_one(customers, ["customer_id", "updated_at"], [F.desc("_loaded_at")])
    known = aliases.select("alias", F.col("state").alias("_state"))
    joined = kept.join(known, F.lower(F.trim("state")) == F.col("alias"), "left")
    return joined.select(
        "customer_id",
        F.col("state").alias("state_raw"),
        F.col("_state").alias("state"),
        F.col("_state").isNotNull().alias("is_state_mapped"),
        F.nullif(F.trim("pincode"), F.lit("")).alias("pincode"),
        "signup_at",
        "updated_at",
        "_source_file",
        "_loaded_at",
    )


def item_id() -> Column:
    return F.concat("order_id", F.lit("-"), F.lpad(F.col("order_item_seq").cast("string"), 2, "0"))


def line_amount() -> Column:
    return (F.col("quantity") * F.col("unit_price")).cast("decimal(14,2)")


def order_items(items: DataFrame) -> DataFrame:
    """One row per order line. The load time alone may tie, so the order names enough columns to be total. Lines are dealt by
    order, as what follows goes by order too: they move once."""
    order = [F.col(c) for c in ("_loaded_at", "product_id", "seller_id", "quantity", "unit_price")]
    kept = keep_one(items.repartition("order_id"), ["order_id", "order_item_seq"], order)
    return kept.select(
        item_id().alias("order_item_id"),
        "order_id", "order_item_seq", "product_id", "seller_id", "quantity", "unit_price",
        line_amount().alias("line_amount"),
        "created_at", "_loaded_at",
    )


def payments(payments: DataFrame) -> DataFrame:
    kept = keep_one(payments, ["payment_id"], [F.col("_loaded_at")])
    return kept.select(
        "payment_id", "order_id", "payment_type", "payment_method", F.col("amount").cast("decimal(14,2)").alias("amount"),
        (F.col("payment_type") == "refund").alias("is_refund"), F.col("created_at").alias("paid_at"), "_loaded_at",
    )


def products(products: DataFrame) -> DataFrame:
    return products.select("product_id", "category", F.col("list_price").cast("decimal(12,2)").alias("list_price"), "weight_kg", "seller_id")


def sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "seller_name", "hub_id")
