"""The driver's tables as the engine's raw feeds.

The feeds are derived by arithmetic on keys only, so that the same rows come out on every run and in any engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.seeds import HUBS, METHODS, sale_calendar


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@dataclass(frozen=True)
class Feeds:
    """Raw feeds and seeds; everything is lazy."""

    orders: DataFrame
    customers: DataFrame
    order_items: DataFrame
    payments: DataFrame
    products: DataFrame
    sellers: DataFrame
    ref_states: DataFrame
    state_aliases: DataFrame
    ref_hubs: DataFrame
    sale_calendar: DataFrame


def _feed(day: str, folder: str) -> dict[str, F.Column]:
    """Lineage of rows that were extracted on a day and loaded the morning after."""
    return {
        "_source_file": F.expr(f"concat('{folder}/dt=', cast({day} as string), '/{folder}.csv')"),
        "_loaded_at": F.expr(f"cast(date_add({day}, 1) as timestamp_ntz)"),
    }


def order_times(orders: DataFrame) -> DataFrame:
    """orders with the times of each stage, by arithmetic on the key k."""
    after = "timestampadd(HOUR, cast({hours} as int), {start})"
    steps = [
        ("purchase_at", after.format(hours="k % 24", start="o_orderdate")),
        ("approved_at", f"case when k % 29 <> 0 then {after.format(hours='1 + k * 7 % 40', start='purchase_at')} end"),
        ("shipped_at", f"case when k % 17 <> 0 then {after.format(hours='2 + k * 13 % 70', start='approved_at')} end"),
        ("arrived_at", f"case when k % 13 <> 0 then {after.format(hours='30 + k * 31 % 220', start='shipped_at')} end"),
        ("delivered_at", f"case when k % 97 = 0 and arrived_at is not null then {after.format(hours='-6', start='shipped_at')} else arrived_at end"),
        (
            "closed_at",
            f"case when k % 29 = 0 then {after.format(hours='5', start='purchase_at')} "
            f"when k % 26 = 0 then {after.format(hours='300', start='shipped_at')} "
            f"when k % 19 = 0 then {after.format(hours='100', start='arrived_at')} end",
        ),
        ("closing", "case when k % 29 = 0 then 'cancelled' when k % 26 = 0 then 'rto' when k % 19 = 0 then 'returned' end"),
    ]
    out = orders.withColumn("k", F.col("o_orderkey"))
    for name, expression in steps:
        out = out.withColumn(name, F.expr(expression))
    return out


def _orders(orders: DataFrame) -> DataFrame:
    methods = F.array(*map(F.lit, METHODS))
    timed = order_times(orders)
    log = timed.select(
        "*",
        F.explode(
            F.expr(
                "array("
                "named_struct('order_status', 'created', 'r', 1, 'updated_at', purchase_at), "
                "named_struct('order_status', 'approved', 'r', 2, 'updated_at', approved_at), "
                "named_struct('order_status', 'shipped', 'r', 3, 'updated_at', shipped_at), "
                "named_struct('order_status', 'delivered', 'r', 4, 'updated_at', arrived_at), "
                "named_struct('order_status', closing, 'r', 5, 'updated_at', closed_at))"
            )
        ).alias("v"),
    ).filter("v.updated_at is not null")
    # one row in 50 is extracted one to three days late, one in 211 is sent again the day after
    log = log.withColumn(
        "day", F.expr("date_add(cast(v.updated_at as date), cast(case when (k + v.r) % 50 = 0 then 1 + k % 3 else 0 end as int))")
    ).withColumn("day", F.explode(F.expr("case when (k + v.r) % 211 = 0 then array(day, date_add(day, 1)) else array(day) end")))
    return log.select(
        F.col("k").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.expr(f"concat('HUB-', cast(k % {HUBS} + 1 as string))").alias("hub_id"),
        F.col("o_orderpriority").alias("courier"),
        F.get(methods, (F.col("k") % len(METHODS)).cast("int")).alias("payment_method"),
        "purchase_at",
        F.expr("date_add(cast(purchase_at as date), cast(8 + k % 5 as int))").alias("estimated_delivery_date"),
        "v.order_status",
        F.expr("case when v.r >= 2 then approved_at end").alias("approved_at"),
        F.expr("case when v.r >= 3 then shipped_at end").alias("shipped_at"),
        F.expr("case when v.r >= 4 then delivered_at end").alias("delivered_at"),
        F.expr("case when v.r = 5 then closed_at end").alias("closed_at"),
        "v.updated_at",
        *[c.alias(n) for n, c in _feed("day", "orders").items()],
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    moves = customer.withColumn("c", F.col("c_custkey")).select(
        "c",
        F.explode(
            F.expr(
                "filter(array("
                "named_struct('v', 1, 'n', c_nationkey % 25, 'updated_at', timestampadd(HOUR, cast(c % 24 as int), timestamp_ntz'1992-01-01 00:00:00')), "
                "named_struct('v', 2, 'n', (c_nationkey + 7) % 25, 'updated_at', case when c % 3 = 0 then timestampadd(DAY, cast(c % 700 as int), timestamp_ntz'1996-06-01 00:00:00') end), "
                "named_struct('v', 3, 'n', (c_nationkey + 11) % 25, 'updated_at', case when c % 9 = 0 then timestampadd(DAY, cast(c % 400 as int), timestamp_ntz'1999-03-01 00:00:00') end)"
                "), m -> m.updated_at is not null)"
            )
        ).alias("m"),
    )
    named = moves.join(F.broadcast(nation.select("n_nationkey", "n_name")), F.col("m.n") == F.col("n_nationkey"))
    # one first version in 67 is sent again a day later, with another pincode
    sent = named.withColumn("again", F.explode(F.expr("case when m.v = 1 and c % 67 = 0 then array(0, 1) else array(0) end")))
    spelt = (
        "case when c % 53 = 0 then 'Atlantis' when (c + m.v) % 4 = 0 then upper(n_name) when (c + m.v) % 4 = 1 then concat('  ', n_name, ' ') "
        "when (c + m.v) % 4 = 2 then concat('N', cast(n_nationkey as string)) else n_name end"
    )
    return sent.withColumn("day", F.expr("date_add(cast(m.updated_at as date), again)")).select(
        F.col("c").cast("string").alias("customer_id"),
        F.expr("case when c % 101 = 0 then '  ' else lpad(cast((c + again) % 900000 as string), 6, '0') end").alias("pincode"),
        F.expr("timestampadd(HOUR, cast(c % 24 as int), timestamp_ntz'1992-01-01 00:00:00')").alias("signup_at"),
        F.col("m.updated_at").alias("updated_at"),
        F.expr(spelt).alias("state"),
        *[c.alias(n) for n, c in _feed("day", "customers").items()],
    )


def _order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").cast("int").alias("order_item_seq"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        # cut to whole cents before the cast, so that no engine has to round a tie
        F.expr("cast(floor(l_extendedprice / l_quantity * 100) / 100 as decimal(12,2))").alias("unit_price"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_shipdate").alias("_loaded_at"),
    )


def _payments(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A charge for each order with lines, plus 49 for shipping below 499, and a refund without it for returned ones."""
    totals = lineitem.groupBy("l_orderkey").agg(F.sum(F.expr("cast(floor(l_extendedprice * 100) / 100 as decimal(12,2))")).alias("total"))
    timed = order_times(orders).join(totals, F.col("k") == F.col("l_orderkey"))
    methods = F.array(*map(F.lit, METHODS))
    rows = timed.select(
        "k",
        F.get(methods, (F.col("k") % len(METHODS)).cast("int")).alias("payment_method"),
        F.explode(
            F.expr(
                "array("
                "named_struct('type', 'charge', 'amount', cast(total + case when total < 499 then 49 else 0 end as decimal(12,2)), 'at', case when k % 6 = 1 then arrived_at else purchase_at end), "
                "named_struct('type', 'refund', 'amount', cast(-total as decimal(12,2)), 'at', case when closing = 'returned' then timestampadd(DAY, 1, closed_at) end)"
                ")"
            )
        ).alias("p"),
    ).filter("p.at is not null")
    return rows.select(
        F.expr("concat(upper(left(p.type, 1)), cast(k as string))").alias("payment_id"),
        F.col("k").cast("string").alias("order_id"),
        F.col("p.type").alias("payment_type"),
        "payment_method",
        F.col("p.amount").alias("amount"),
        F.col("p.at").alias("created_at"),
        F.expr("cast(date_add(cast(p.at as date), 1) as timestamp_ntz)").alias("_loaded_at"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    t = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region", "lineitem", "part", "supplier")}
    places = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    states = places.select(
        F.col("n_name").alias("state"),
        F.expr("concat('N', cast(n_nationkey as string))").alias("state_code"),
        F.col("r_name").alias("region"),
        F.expr("cast(n_nationkey % 3 + 1 as int)").alias("remoteness_tier"),
    )
    aliases = t["nation"].select(
        F.explode(F.expr("array(lower(n_name), concat('n', cast(n_nationkey as string)))")).alias("alias"), F.col("n_name").alias("state")
    )
    hubs = places.filter(f"n_nationkey % 3 = 1 and n_nationkey div 3 < {HUBS}").select(
        F.expr("concat('HUB-', cast(n_nationkey div 3 + 1 as string))").alias("hub_id"),
        F.col("n_name").alias("hub_state"),
        F.col("r_name").alias("hub_region"),
    )
    products = t["part"].select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("category"),
        F.expr("cast(floor(p_retailprice * 100) / 100 as decimal(12,2))").alias("list_price"),
        F.col("p_size").cast("double").alias("weight_kg"),
        F.expr("cast(p_partkey % 100 as string)").alias("seller_id"),
    )
    sellers = t["supplier"].select(
        F.col("s_suppkey").cast("string").alias("seller_id"),
        F.col("s_name").alias("seller_name"),
        F.expr(f"concat('HUB-', cast(s_suppkey % {HUBS} + 1 as string))").alias("hub_id"),
    )
    return Feeds(
        orders=_orders(t["orders"]),
        customers=_customers(t["customer"], t["nation"]),
        order_items=_order_items(t["lineitem"]),
        payments=_payments(t["orders"], t["lineitem"]),
        products=products,
        sellers=sellers,
        ref_states=states,
        state_aliases=aliases,
        ref_hubs=hubs,
        sale_calendar=sale_calendar(spark),
    )
