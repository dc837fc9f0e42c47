"""Column contracts: the raw feeds and the central fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F


def _decimal(kind: str) -> T.DecimalType:
    precision, scale = kind[8:-1].split(",")
    return T.DecimalType(int(precision), int(scale))


def _build(text: str, required: tuple[str, ...] = ()) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "ts": T.TimestampNTZType(), "boolean": T.BooleanType()}
    fields = []
    for part in text.split(", "):
        name, kind = part.split(" ", 1)
        fields.append(T.StructField(name, kinds.get(kind) or _decimal(kind), name not in required))
    return T.StructType(fields)


LINEAGE = "_source_file string, _loaded_at ts, _load_id string"
RAW = {
    "orders": _build(
        "order_id string, customer_id string, hub_id string, courier string, payment_method string, purchase_at ts, "
        "estimated_delivery_date date, order_status string, approved_at ts, shipped_at ts, delivered_at ts, closed_at ts, updated_at ts"
    ),
    "order_items": _build(
        "order_id string, order_item_seq int, product_id string, seller_id string, quantity int, unit_price decimal(12,2), created_at ts"
    ),
    "payments": _build("payment_id string, order_id string, payment_type string, payment_method string, amount decimal(12,2), created_at ts"),
    "customers": _build("customer_id string, pincode string, signup_at ts, updated_at ts, state string"),
}
SNAPSHOTS = {
    "products": _build("product_id string, category string, list_price decimal(12,2), weight_kg double, seller_id string"),
    "sellers": _build("seller_id string, seller_name string, hub_id string, hub_state string, onboarded_at ts"),
}
MANIFEST = _build("entity string, file_path string, file_bytes long, file_mtime ts, rows_loaded long, load_id string, loaded_at ts", ("entity", "file_path"))
FACT = _build(
    "order_id string, customer_sk string, customer_id string, order_date_key int, order_date date, customer_state string, "
    "customer_region string, remoteness_tier int, hub_id string, hub_region string, courier string, payment_method string, "
    "sale_event string, current_status string, purchase_at ts, approved_at ts, shipped_at ts, delivered_at ts, closed_at ts, "
    "estimated_delivery_date date, is_delivered boolean, is_cancelled boolean, is_returned boolean, is_rto boolean, is_open boolean, "
    "is_cross_region boolean, is_late boolean, days_late long, is_open_and_overdue boolean, breached_approval_sla boolean, "
    "has_timestamp_anomaly boolean, approval_hours double, processing_hours double, transit_days double, delivery_days double, "
    "item_count long, units long, primary_category string, gross_merchandise_value decimal(14,2), amount_charged decimal(14,2), "
    "amount_refunded decimal(14,2), net_revenue decimal(14,2), version_count long, had_late_arrival boolean, source_last_loaded_at ts",
    ("order_id", "current_status"),
)


class ContractError(ValueError):
    """A table is not what its contract says."""


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """df, once its columns have the contract's names, order and types, with NOT NULL columns guarded at run time."""
    have = [(f.name, f.dataType) for f in df.schema]
    want = [(f.name, f.dataType) for f in contract]
    if have != want:
        odd = [f"{h} should be {w}" for h, w in zip(have, want) if h != w]
        raise ContractError("; ".join(odd) or f"{len(have)} columns, {len(want)} expected")
    required = [f.name for f in contract if not f.nullable]
    guarded = {
        c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")).cast(df.schema[c].dataType)) for c in required
    }
    return df.withColumns(guarded).select(df.columns) if guarded else df
