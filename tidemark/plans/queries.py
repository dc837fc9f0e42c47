"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import long, rounded
from tidemark.operators import checks
from tidemark.operators.asof import asof_join
from tidemark.operators.incremental import delete_insert
from tidemark.operators.intervals import interval_totals
from tidemark.operators.joins import calendar_join, point_in_time_join
from tidemark.operators.rolling import rolling_zscore
from tidemark.plans import core, dashboard, intermediate, marts
from tidemark.plans.build import models, suite
from tidemark.plans.seeds import sale_calendar
from tidemark.plans.warehouse import Warehouse, changes, clustered_changes
from tidemark.session import dealt, scratch, scratch_folder
from tidemark.sources.clustered import FeedStore
from tidemark.sources.freshness import freshness
from tidemark.sources.tables import Feeds, read

#: Parameters of the dashboard queries.
FILTERS = dashboard.Filters(date(1996, 1, 1), date(2000, 12, 31), ("ASIA", "EUROPE", "AMERICA"), "Prepaid")
QUALITY = (date(1997, 1, 1), date(1997, 3, 31))
SPLIT = "1998-06-01"
TESTED = ("orders_cdc", "customers_cdc", "order_items", "payments", "status_history", "customers_scd2", "fct_orders", "state_scorecard", "order_funnel")
#: What these tests, and the models under them, take from the models that are stored for them.
KEPT_FOR_TESTS = {
    "orders_cdc": ("order_version_id", "order_id", "order_status", "purchase_at", "updated_at", "duplicate_copies_dropped"),
    "latest": ("customer_id", "hub_id", "approved_at", "shipped_at", "delivered_at", "estimated_delivery_date"),
    "order_items": ("order_item_id", "order_id", "quantity", "unit_price", "line_amount"),
    "payments": ("payment_id", "order_id", "payment_type", "amount", "is_refund"),
    "customers_scd2": ("customer_sk", "customer_id", "state", "valid_from", "valid_to", "is_current"),
    "fct_orders": tuple(dict.fromkeys((
        *marts.GUARDED, "order_date_key", "customer_sk", "days_late", "net_revenue", "delivered_at", "gross_merchandise_value",
        *marts.FACT_COLUMNS["state_scorecard"], *marts.FACT_COLUMNS["order_funnel"],
    ))),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def model(name: str, build: Callable[[Warehouse], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Warehouse.over(spark, sf_dir))


# Change log
model("dedup_order_versions", lambda w: w.orders_cdc)
model("dedup_customer_versions", lambda w: w.customers_cdc.select("customer_id", "updated_at", "pincode", "state_raw", "_loaded_at"))
model("customers_alias_normalised", lambda w: w.customers_cdc.drop("_source_file", "_loaded_at"))
model("dedup_items", lambda w: w.order_items)
model("dedup_payments", lambda w: w.payments)
model("staged_products", lambda w: w.products)
model("staged_sellers", lambda w: w.sellers)
model("latest_version", lambda w: w.latest.drop("_source_file"))
model("status_history", lambda w: w.status_history.withColumn("hours_in_status", rounded(F.col("hours_in_status"), 4)))
model("late_arrival_flags", lambda w: w.orders_cdc.groupBy("order_status", "is_late_arrival").agg(F.count("*").alias("versions"), F.sum("duplicate_copies_dropped").cast("long").alias("dropped")))

# History and point in time
# the year 9999 is beyond what nanosecond clients can hold, so it leaves as text
model("customers_scd2", lambda w: w.customers_scd2.withColumn("valid_to", F.col("valid_to").cast("string")))
model("items_by_order", lambda w: w.items_by_order)
model("payments_by_order", lambda w: w.payments_by_order)
model("orders_lifecycle", lambda w: w.lifecycle)


@query
def events_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user in the event log, with the number of events and the last arrival."""
    events = read(spark, sf_dir, "events")
    rank = F.create_map(*[F.lit(x) for p in (("signup", 1), ("view", 2), ("click", 3), ("purchase", 4), ("error", 5)) for x in p])
    best = F.max_by(F.struct("event_type", "value"), F.struct("ts", F.element_at(rank, F.col("event_type")), "event_id"))
    return events.groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"), best.alias("b")).select(
        "user_id", "events", "last_ts", "b.event_type", F.col("b.value").alias("value")
    )


@query
def point_in_time_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Warehouse.over(spark, sf_dir)
    valid = w.customers_scd2.select("customer_id", "customer_sk", "state", "version_number", "valid_from", "valid_to")
    return point_in_time_join(
        w.latest.select("order_id", "customer_id", "purchase_at"), valid, "customer_id", F.col("purchase_at"), ["customer_sk", "state", "version_number"]
    )


QUERIES["point_in_time_join"] = QUERIES.pop("point_in_time_join_orders")


@query
def asof_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's state at purchase: that of the last move before it, else the one at sign-up."""
    w = Warehouse.over(spark, sf_dir)
    known = w.customers_scd2.select("customer_id", "state", "valid_from", "version_number")
    at_first = known.filter("version_number = 1").select("customer_id", F.col("state").alias("first_state"))
    moves = known.filter("version_number > 1").withColumn("moved_at", F.col("valid_from"))
    orders = w.latest.select("order_id", "customer_id", "purchase_at").join(at_first, "customer_id", "left")
    return asof_join(orders, moves, "customer_id", "purchase_at", "valid_from", ["state", "moved_at"], otherwise={"state": F.col("first_state")})


QUERIES["asof_join"] = QUERIES.pop("asof_join_orders")


@query
def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of the log with the user's last sign-up until then, if there was one."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    signups = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"))
    return asof_join(events, signups.withColumn("since", F.col("signup_ts")), "user_id", "ts", "since", ["signup_ts", "signup_id"])


@query
def interval_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of the log with the sign-ups whose period holds it: from an hour to weeks from the sign-up on, overlapping."""
    events = read(spark, sf_dir, "events")
    periods = events.filter("event_type = 'signup'").select(
        F.col("event_id").alias("signup_id"), F.col("ts").alias("begins"), F.expr("timestampadd(HOUR, cast(1 + event_id * event_id % 500 as int), ts)").alias("ends")
    )
    found = interval_totals(events.select("event_id", "ts", "event_type"), periods, "ts", "begins", "ends", "signup_id")
    return found.groupBy("event_id", "event_type").agg(F.sum("periods").alias("open_periods"), F.min("least").alias("first_signup"), F.max("most").alias("last_signup"))


QUERIES["interval_join"] = QUERIES.pop("interval_join_events")


@query
def pit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose state at purchase is not the customer's present one."""
    w = Warehouse.over(spark, sf_dir)
    now = w.customers_scd2.filter("is_current").select("customer_id", F.col("state").alias("state_now"))
    then = w.fct_orders.select("order_id", "customer_id", "customer_state")
    return then.join(now, "customer_id").filter(~F.col("customer_state").eqNullSafe(F.col("state_now")))


@query
def sale_calendar_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))
    return calendar_join(orders, sale_calendar(spark), F.col("order_date"))


# Star schema
model("fct_orders", lambda w: w.fct_orders)
model("fct_order_items", lambda w: w.fct_order_items)
model("fct_order_status_history", lambda w: w.fct_order_status_history.withColumn("hours_in_status", rounded(F.col("hours_in_status"), 4)))
model("dim_customers", lambda w: w.dim_customers.withColumn("valid_to", F.col("valid_to").cast("string")))
model("dim_hubs", lambda w: w.dim_hubs)
model("dim_products", lambda w: w.dim_products)
model("dim_geography", lambda w: w.dim_geography)
model("dim_date", lambda w: w.dim_date)

# Marts
for _mart in ("fulfillment_daily", "state_scorecard", "courier_performance", "stage_bottlenecks", "order_funnel", "sale_event_impact", "data_quality_daily"):
    model(_mart, lambda w, m=_mart: getattr(w, m))


@query
def volume_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", "n", rounded(rolling_zscore("day", "n"), 2).alias("zscore"))


# Dashboard
model("order_date_bounds", lambda w: dashboard.order_date_bounds(w.fct_orders))
model("distinct_regions", lambda w: dashboard.distinct_regions(w.dim_geography))
for _tile in (dashboard.kpi_tiles, dashboard.weekly_trend, dashboard.courier_periods):
    model(_tile.__name__, lambda w, t=_tile: t(w.fct_orders, FILTERS))
model("filtered_state_health", lambda w: dashboard.state_health(w.fct_orders, FILTERS))
model("slowest_states_topk", lambda w: dashboard.slowest_states(w.fct_orders, FILTERS))
model("quality_between", lambda w: dashboard.quality_between(w.data_quality_daily, *QUALITY))
model("latest_days_tail", lambda w: dashboard.latest_days(w.data_quality_daily))
model("scorecard_by_rank", lambda w: w.state_scorecard.select("on_time_rank", "state", "orders", "on_time_rate", "sla_health").orderBy("on_time_rank", "state"))
model("sale_impact_listing", lambda w: marts.sale_event_impact(w.fct_orders, w.feeds.sale_calendar).select("sale_event", "start_date", "volume_uplift", "on_time_rate_delta").orderBy("start_date"))


# Assertions, on inputs that violate them
@query
def completeness_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return checks.missing(orders.select(F.col("o_orderkey").alias("order_key")), lines.select(F.col("l_orderkey").alias("order_key")), "order_key")


@query
def check_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return checks.relationships(orders.select("o_orderkey", "o_custkey"), "o_orderkey", lines, "l_orderkey")


@query
def check_unique_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique_combination(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


model("check_one_current_row", lambda w: checks.one_current_row_per_key(w.orders_cdc.withColumn("current", F.col("order_status") == "delivered"), "order_id", "current"))
model("check_scd2_no_overlaps", lambda w: checks.scd2_no_overlaps(w.customers_scd2.filter("version_number <> 2"), "customer_id", "valid_from", "valid_to"))
model("check_timestamps_in_order", lambda w: checks.timestamps_in_order(w.fct_orders, "shipped_at", "delivered_at", F.col("is_delivered")).select("order_id", "shipped_at", "delivered_at"))
model("check_value_between", lambda w: checks.value_between(w.fct_orders, "days_late", 0, 2).select("order_id", "days_late"))
model("check_positive_value", lambda w: checks.positive_value(w.feeds.payments, "amount").select("payment_id", "amount"))
model("check_unique", lambda w: checks.unique(w.order_items, "product_id"))
model("check_not_null", lambda w: checks.not_null(w.fct_orders, "primary_category").select("order_id"))
model("check_accepted_values", lambda w: checks.accepted_values(w.orders_cdc, "order_status", ["created", "approved", "shipped", "delivered"]))


@query
def data_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the data tests of TESTED, as a build counts them. What several of them read is stored, with the columns that
    they take, so each feed is sorted or joined once."""
    w = Warehouse.over(spark, sf_dir)
    chosen = tuple(m for m in models() if m.name in TESTED)
    with scratch(spark) as folder:
        w.store_versions(folder, KEPT_FOR_TESTS["orders_cdc"], KEPT_FOR_TESTS["latest"])
        # copies of a version repeat its times, so the versions have the newest event and the first and last purchase, too
        w.clock, w.__dict__["dim_date"] = w.orders_cdc, core.dim_date(w.orders_cdc, w.feeds.sale_calendar)
        once = checks.unique(w.products, "product_id").isEmpty()
        w.store("order_items", folder, *KEPT_FOR_TESTS["order_items"], *() if once else ("product_id",))
        if once:  # no test reads categories
            w.__dict__["items_by_order"] = intermediate.amounts_by_order(w.order_items)
        for name in ("payments", "customers_scd2", "fct_orders"):
            w.store(name, folder, *KEPT_FOR_TESTS[name])
        w.__dict__["stored_fact"] = w.fct_orders
        for name in ("state_scorecard", "order_funnel"):
            w.store(name, folder)
        found = suite(w, chosen)
    return spark.createDataFrame(found, "model string, test string, severity string, failures long, status string")


@query
def marts_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the marts beside those of the fact."""
    stored = Warehouse.over(spark, sf_dir).fact_for("fulfillment_daily", "state_scorecard", "order_funnel", "courier_performance")
    fact = stored.agg(F.count("*").alias("fact_value"), F.count("shipped_at").alias("fact_shipped"))
    parts = [
        ("fulfillment_daily", marts.fulfillment_daily(stored).agg(F.sum("orders").alias("v")), "fact_value"),
        ("state_scorecard", marts.state_scorecard(stored).agg(F.sum("orders").alias("v")), "fact_value"),
        ("order_funnel", marts.order_funnel(stored).agg(F.sum("placed").alias("v")), "fact_value"),
        ("courier_performance", marts.courier_performance(stored).agg(F.sum("shipments").alias("v")), "fact_shipped"),
    ]
    rows = [
        p.join(F.broadcast(fact)).select(F.lit(name).alias("mart"), long(F.col("v")).alias("mart_value"), F.col(c).alias("fact_value"))
        for name, p, c in parts
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("agrees", F.abs(F.col("mart_value") - F.col("fact_value")) == 0)


@query
def revenue_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled orders that were kept but whose net revenue isn't their lines plus shipping."""
    fact, s = Warehouse.over(spark, sf_dir).stored_fact, intermediate.Settings()
    newest = F.broadcast(fact.agg(F.max("delivered_at").alias("newest")))
    gmv = F.col("gross_merchandise_value")
    expected = gmv + F.when(gmv < F.lit(s.free_shipping_from).cast("decimal(14,2)"), F.lit(s.shipping).cast("decimal(14,2)")).otherwise(F.lit(0).cast("decimal(14,2)"))
    settled = (F.col("current_status") == "delivered") & (F.col("delivered_at") < F.col("newest") - F.expr(f"interval {s.settled_days} days"))
    rows = fact.join(newest).filter(settled).withColumn("expected", expected.cast("decimal(14,2)"))
    return rows.filter(F.abs(F.col("net_revenue") - F.col("expected")) > F.lit(s.tolerance).cast("decimal(4,2)")).select("order_id", "net_revenue", "expected")


def _landed(f: Feeds) -> Feeds:
    """f with payments stored as they come in: they are derived from a join of all lines, and an increment reads them again and again."""
    return replace(f, payments=dealt(f.payments, "order_id"))


@query
def incremental_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact built and stored from what was loaded up to SPLIT, then maintained with the rest. Equals a full build but for
    the load time, which is left out."""
    f = _landed(Warehouse.over(spark, sf_dir).feeds)
    early = F.col("_loaded_at") <= F.lit(SPLIT).cast("timestamp_ntz")
    stored = Warehouse(replace(f, orders=f.orders.filter(early), payments=f.payments.filter(early))).dealt_fact()
    late, keys = changes(f, stored)
    return delete_insert(stored, late.fct_by_steps(scratch_folder(spark)), keys).drop("source_last_loaded_at")


@query
def clustered_incremental_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As incremental_fact, over feeds that are stored by the month of their orders."""
    f = _landed(Warehouse.over(spark, sf_dir).feeds)
    until = F.lit(SPLIT).cast("timestamp_ntz")
    store = FeedStore(spark, scratch_folder(spark))
    early = replace(f, orders=f.orders.filter(F.col("_loaded_at") <= until), payments=f.payments.filter(F.col("_loaded_at") <= until))
    store.add(early)
    stored = Warehouse(early).dealt_fact()
    none = f.order_items.limit(0)  # all lines came with the first load
    store.add(replace(f, orders=f.orders.filter(F.col("_loaded_at") > until), payments=f.payments.filter(F.col("_loaded_at") > until), order_items=none))
    late, keys = clustered_changes(store, f, stored)
    return delete_insert(stored, late.fct_by_steps(scratch_folder(spark)), keys).drop("source_last_loaded_at")


@query
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each feed against the newest load: warn from 1 day, error from 3."""
    f = Warehouse.over(spark, sf_dir).feeds
    return freshness({name: getattr(f, name) for name in ("orders", "customers", "order_items", "payments")})
