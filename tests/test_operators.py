import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import STATUS_RANK, path_date, rounded, status_rank
from tidemark.operators import checks
from tidemark.operators.incremental import Versioned, affected, delete_insert
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.rolling import rolling_zscore
from tidemark.operators.versions import keep_one, latest_version, scd2, status_history
from tidemark.plans import marts
from tidemark.plans.intermediate import orders_lifecycle
from tidemark.plans.warehouse import Warehouse
from tidemark.schemas import FACT, ContractError, conform
from tidemark.sources.tables import Feeds


def ts(text):
    return datetime.fromisoformat(text)


VERSIONS = "order_id string, order_status string, status_precedence int, updated_at timestamp_ntz, _loaded_at timestamp_ntz, is_late_arrival boolean"


def test_latest_version_of_many_orders_equals_the_definition(spark):
    """Random logs with ties of time and of time and rank; when rows arrived tells nothing."""
    draw = random.Random(12)
    names = [*STATUS_RANK, "lost"]
    rows = []
    for n in range(300):
        for _ in range(draw.randrange(1, 6)):
            status = draw.choice(names)
            at = datetime(2021, 5, 1) + timedelta(hours=draw.randrange(4))
            rows.append((f"order {n % 120}", status, STATUS_RANK.get(status, 0), at, at + timedelta(days=draw.randrange(9)), draw.random() < 0.2))
    found = {r["order_id"]: r for r in latest_version(spark.createDataFrame(rows, VERSIONS)).collect()}
    assert set(found) == {r[0] for r in rows}
    for key, r in found.items():
        mine = [x for x in rows if x[0] == key]
        assert (r["updated_at"], r["status_precedence"]) == max((x[3], x[2]) for x in mine)
        assert (r["version_count"], r["had_late_arrival"], r["last_loaded_at"]) == (len(mine), any(x[5] for x in mine), max(x[4] for x in mine))


ORDERS = (
    "order_id string, customer_id string, hub_id string, courier string, payment_method string, order_status string, version_count long, "
    "had_late_arrival boolean, purchase_at timestamp_ntz, approved_at timestamp_ntz, shipped_at timestamp_ntz, delivered_at timestamp_ntz, "
    "closed_at timestamp_ntz, estimated_delivery_date date, updated_at timestamp_ntz, last_loaded_at timestamp_ntz"
)


def life(spark, **given):
    """The life cycle of one order of a customer who lived in Low until 2021-06-10 12:00 and in High from then on."""
    order = {
        "order_id": "x", "customer_id": "anna", "hub_id": "h1", "courier": "foot", "payment_method": "Wallet", "order_status": "shipped", "version_count": 3, "had_late_arrival": True,
        "purchase_at": ts("2021-06-10 12:00"), "approved_at": ts("2021-06-11 13:00"), "shipped_at": ts("2021-06-12 01:00"), "delivered_at": None, "closed_at": None,
        "estimated_delivery_date": date(2021, 6, 20), "updated_at": ts("2021-06-12 01:00"), "last_loaded_at": ts("2021-06-13"),
    } | given
    latest = spark.createDataFrame([tuple(order.values())], ORDERS)
    customers = spark.createDataFrame(
        [("a1", "anna", "Low", ts("2020-01-01"), ts("2021-06-10 12:00")), ("a2", "anna", "High", ts("2021-06-10 12:00"), ts("9999-12-31"))],
        "customer_sk string, customer_id string, state string, valid_from timestamp_ntz, valid_to timestamp_ntz",
    )
    states = spark.createDataFrame([("Low", "L", "Plain", 1), ("High", "H", "Hills", 3)], "state string, state_code string, region string, remoteness_tier int")
    hubs = spark.createDataFrame([("h1", "Low", "Plain")], "hub_id string, hub_state string, hub_region string")
    sales = spark.createDataFrame([("Fair", date(2021, 6, 8), date(2021, 6, 10))], "sale_event string, start_date date, end_date date")
    now = spark.createDataFrame([(ts("2021-06-20 23:00"),), (ts("2021-06-01"),)], "updated_at timestamp_ntz")
    paid = spark.createDataFrame([("x", ts("2021-06-12")), ("y", ts("2021-07-01"))], "order_id string, _loaded_at timestamp_ntz")
    return orders_lifecycle(latest, now, customers, states, hubs, sales, paid).first()


def test_a_purchase_on_the_boundary_belongs_to_the_later_version(spark):
    r = life(spark)
    assert (r["customer_sk"], r["customer_state"], r["remoteness_tier"], r["is_cross_region"]) == ("a2", "High", 3, True)
    before = life(spark, purchase_at=ts("2021-06-10 11:59:59"))
    assert (before["customer_sk"], before["customer_region"], before["is_cross_region"]) == ("a1", "Plain", False)


def test_a_purchase_without_a_known_customer_stays(spark):
    for order in (life(spark, customer_id="nobody"), life(spark, purchase_at=ts("2019-12-31 23:00")), life(spark, customer_id=None)):
        assert (order["customer_sk"], order["customer_state"], order["customer_region"], order["is_cross_region"]) == (None, None, None, None)
    assert life(spark, hub_id="elsewhere")["is_cross_region"] is None


def test_open_orders_are_due_on_their_last_day(spark):
    r = life(spark)
    assert r["is_open"] and not r["is_open_and_overdue"] and (r["is_late"], r["days_late"], r["transit_days"], r["delivery_days"]) == (None, None, None, None)
    assert life(spark, estimated_delivery_date=date(2021, 6, 19))["is_open_and_overdue"]
    assert r["approval_hours"] == 25.0 and r["breached_approval_sla"] and r["processing_hours"] == 12.0 and r["sale_event"] == "Fair"
    assert life(spark, approved_at=ts("2021-06-11 12:00"))["breached_approval_sla"] is False
    assert life(spark, purchase_at=ts("2021-06-11 00:00"))["sale_event"] is None


def test_deliveries_are_late_by_days(spark):
    done = {"order_status": "delivered", "delivered_at": ts("2021-06-20 23:59")}
    r = life(spark, **done)
    assert (r["is_delivered"], r["is_late"], r["days_late"], r["has_timestamp_anomaly"]) == (True, False, 0, False) and r["transit_days"] == pytest.approx(8 + 22.9833333 / 24)
    assert life(spark, order_status="delivered", delivered_at=ts("2021-06-23 00:01"))["days_late"] == 3
    odd = life(spark, order_status="returned", delivered_at=ts("2021-06-11 20:00"))
    assert odd["has_timestamp_anomaly"] and odd["transit_days"] is None and odd["is_returned"] and odd["is_delivered"]
    assert r["source_last_loaded_at"] == ts("2021-06-13") and life(spark, last_loaded_at=ts("2021-06-11"))["source_last_loaded_at"] == ts("2021-06-12")


def test_history_and_scd2(spark):
    rows = [("A", "created", 1, ts("2024-01-01"), ts("2024-01-02"), False), ("A", "approved", 2, ts("2024-01-01 12:00"), ts("2024-01-02"), False)]
    df = spark.createDataFrame(rows, VERSIONS).withColumn("order_version_id", F.col("order_status"))
    first, last = status_history(df).orderBy("status_sequence").collect()
    assert (first["hours_in_status"], first["is_current"], last["previous_status"], last["valid_to"]) == (12.0, False, "created", None)
    dim = scd2(df.select(F.col("order_id").alias("customer_id"), "updated_at"))
    assert checks.scd2_no_overlaps(dim, "customer_id", "valid_from", "valid_to").isEmpty()
    assert checks.one_current_row_per_key(dim, "customer_id", "is_current").isEmpty()


def test_keep_one_counts_copies(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    assert sorted(map(tuple, keep_one(df, ["k"], [F.col("v")], copies="n").collect())) == [("a", 1, 2), ("b", 5, 1)]


def test_columns(spark):
    row = spark.range(1).select(
        rounded(F.lit(-2.5), 0).alias("a"), rounded(F.lit(1.005), 2).alias("b"), rounded(F.lit(-0.001), 2).alias("c"),
        path_date(F.lit("orders/dt=2024-02-29/x.csv")).alias("d"), path_date(F.lit("none")).alias("e"), status_rank(F.lit("odd")).alias("f"),
    ).first()
    assert tuple(row) == (-3.0, 1.01, 0.0, date(2024, 2, 29), None, 0) and str(row["c"]) == "0.0"


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (lambda d: checks.not_null(d, "k"), [("a", 1)], [(None, 1)]),
        (lambda d: checks.unique(d, "k"), [("a", 1), (None, 1), (None, 2)], [("a", 1), ("a", 2)]),
        (lambda d: checks.unique_combination(d, ["k", "v"]), [("a", 1), ("a", 2)], [("a", 1), ("a", 1)]),
        (lambda d: checks.accepted_values(d, "k", ["a"]), [("a", 1)], [("b", 1)]),
        (lambda d: checks.positive_value(d, "v"), [("a", 1)], [("a", 0)]),
        (lambda d: checks.value_between(d, "v", 0, 5), [("a", 5), ("b", None)], [("a", 6)]),
        (lambda d: checks.value_between(d, "v", least=2), [("a", 9)], [("a", 1)]),
        (lambda d: checks.timestamps_in_order(d.selectExpr("v a", "3 b"), "a", "b"), [("a", 2)], [("a", 4)]),
        (lambda d: checks.relationships(d, "k", d.filter("v = 1"), "k"), [("a", 1), (None, 2)], [("a", 1), ("b", 2)]),
        (lambda d: checks.missing(d, d.filter("v = 1"), "k"), [("a", 1)], [("b", 2)]),
        (lambda d: checks.one_current_row_per_key(d.selectExpr("k", "v = 1 c"), "k", "c"), [("a", 1), ("a", 2)], [("a", 1), ("a", 1)]),
    ],
)
def test_assertions_pass_and_fail(spark, check, good, bad):
    assert check(spark.createDataFrame(good, "k string, v int")).isEmpty()
    assert not check(spark.createDataFrame(bad, "k string, v int")).isEmpty()


def test_scd2_gaps_are_found(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 9)], "k string, s int, e int")
    assert checks.scd2_no_overlaps(df, "k", "s", "e").count() == 1


def test_contract(spark):
    empty = spark.createDataFrame([], FACT)
    assert conform(empty, FACT).count() == 0 and len(FACT) == 45
    with pytest.raises(ContractError):
        conform(empty.withColumn("units", F.lit("x")), FACT)
    broken = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in FACT])
    with pytest.raises(Exception, match="order_id is null"):
        conform(broken, FACT).collect()


def test_delete_insert_and_affected(spark):
    """Affected: loaded after all that the target has seen, in either feed, and what the target has as open."""
    schema = "order_id string, _loaded_at timestamp_ntz"
    orders = spark.createDataFrame([("a", ts("2024-01-01")), ("b", ts("2024-01-03")), ("c", ts("2024-01-03"))], schema)
    payments = spark.createDataFrame([("a", ts("2024-01-02")), ("e", ts("2024-01-04"))], schema)
    none = [None] * 8
    source = Feeds(orders, none[0], none[1], payments, *none[2:])
    old = spark.createDataFrame([("a", ts("2024-01-02"), False), ("b", ts("2024-01-01"), False), ("d", ts("2024-01-01"), True)], "order_id string, source_last_loaded_at timestamp_ntz, is_open boolean")
    assert sorted(r[0] for r in affected(source, old).collect()) == ["b", "c", "d", "e"]
    assert sorted(r[0] for r in affected(source, old.limit(0)).collect()) == ["a", "b", "c", "e"]
    values = spark.createDataFrame([("a", 1), ("b", 1)], "order_id string, v int")
    merged = delete_insert(values, spark.createDataFrame([("b", 2), ("c", 2)], "order_id string, v int"))
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_versions_are_published_by_pointer(spark, tmp_path):
    data = Versioned(spark, str(tmp_path / "fact"))
    assert data.read() is None
    data.publish(spark.range(3))
    first = data.current()
    data.publish(data.read().filter("id < 2"))
    assert data.current() != first and data.read().count() == 2


def test_zscore_needs_two_days_before(spark):
    df = spark.createDataFrame([(date(2024, 1, d), n) for d, n in ((1, 10), (2, 12), (3, 20))], "day date, n long")
    found = [r["z"] for r in df.select("day", rolling_zscore("day", "n").alias("z")).orderBy("day").collect()]
    assert found[:2] == [None, None] and found[2] == pytest.approx((20 - 11) / 2**0.5)


def test_zscore_of_large_volumes(spark):
    """A thousand million rows a day overflow nothing, and the spread isn't lost beside the mean."""
    df = spark.createDataFrame([(date(2024, 1, d), 1_000_000_000 + d) for d in range(1, 20)], "day date, n long")
    found = [r["z"] for r in df.select("day", rolling_zscore("day", "n").alias("z")).orderBy("day").collect()]
    assert found[:2] == [None, None]
    for k in range(2, 19):
        before = list(range(1, k + 1))
        mean = sum(before) / k
        assert found[k] == pytest.approx((k + 1 - mean) / (sum((x - mean) ** 2 for x in before) / (k - 1)) ** 0.5, rel=1e-6)
    flat = spark.createDataFrame([(date(2024, 1, d), 7) for d in range(1, 6)], "day date, n long")
    assert [r["z"] for r in flat.select(rolling_zscore("day", "n").alias("z")).collect()] == [None] * 5


def test_exact_quantiles(spark):
    """As the percentile aggregate has them: ties, one value, nulls, a null key, bins of one and of many values."""
    rows = [(k, float(v)) for k, values in {"a": range(101), "b": [7], "c": [1, 1, 1, 2], "d": [0.1 * i for i in range(37)], None: [5, 6]}.items() for v in values]
    df = spark.createDataFrame([*rows, ("a", None), ("none", None)], "k string, v double")
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    expected = {r["k"]: tuple(r)[1:] for r in df.filter("v is not null").groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()}
    for most in (1, 5, 1000):
        found = {r["k"]: tuple(r)[1:] for r in exact_quantiles(df, ["k"], "v", shares, most).collect()}
        assert {k: pytest.approx(v) for k, v in expected.items()} == found


def test_exact_quantiles_of_crowded_bins(spark):
    """A million values, nearly all within an hour, beside one far away: bins are refined where the ranks are."""
    df = spark.range(1_000_000).selectExpr("id % 2 k", "case when id = 7 then 1e9 else pmod(id * 7919, 1000003) / 1000003 / 24 end v")
    df = df.unionByName(spark.createDataFrame([(3, float("inf")), (3, 1.0), (3, float("nan")), (4, None)], "k long, v double"))
    df = df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
    shares = {"p50": 0.5, "p90": 0.9, "p999": 0.999}
    found = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", shares, 1000).collect()}
    expected = df.filter("k < 2").groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()
    for r in expected:
        assert tuple(found[r["k"]])[1:] == pytest.approx(tuple(r)[1:], rel=1e-12)
    assert set(found) == {0, 1, 3} and found[3]["p50"] > 1e300


def test_marts_have_no_percentile_aggregates(spark, sf_dir):
    from tidemark.plans.warehouse import Warehouse

    w = Warehouse.over(spark, sf_dir)
    for mart in (w.fulfillment_daily, w.courier_performance, w.state_scorecard):
        assert "ObjectHashAggregate" not in mart._jdf.queryExecution().toString()


def test_a_fact_for_one_mart_leaves_out_what_the_mart_does_not_take(spark, sf_dir):
    """Couriers need neither lines nor payments, states no payments: tables and joins that bring them aren't planned."""
    w = Warehouse.over(spark, sf_dir)
    taken = w.fct_orders.select(*marts.GUARDED, *marts.FACT_COLUMNS["courier_performance"])
    assert "l_orderkey" not in taken._jdf.queryExecution().optimizedPlan().toString()
    assert set(w.fact_for("courier_performance").columns) == set(taken.columns)


def test_orders_move_to_their_customers_and_not_back(spark, sf_dir):
    """Versions are sorted once, and the rows of the fact are dealt anew by customer alone after they were dealt by order."""
    fact = Warehouse.over(spark, sf_dir).fct_orders
    whole = fact._jdf.queryExecution().executedPlan().toString().split("\n")
    above = whole[: next(i for i, row in enumerate(whole) if "hashpartitioning(customer_id" in row)]
    assert not any("hashpartitioning(order_id" in row for row in above)
    assert not any("status_precedence" in row and "DESC" in row and "Sort [" in row for row in whole)


def test_a_fact_by_order_moves_before_its_columns_are_worked_out(spark, sf_dir):
    """What goes back from customers to orders is the order with its customer; durations and flags come after that."""
    plan = Warehouse.over(spark, sf_dir).fct_by_order._jdf.queryExecution().executedPlan().toString().split("\n")
    back = next(i for i, row in enumerate(plan) if "hashpartitioning(order_id" in row and "REPARTITION" in row)
    assert "hashpartitioning(customer_id" not in "".join(plan[:back])
    assert not any("approval_hours" in row for row in plan[back:])


def test_lines_move_to_their_products_without_what_can_be_worked_out(spark, sf_dir):
    plan = Warehouse.over(spark, sf_dir).fct_order_items._jdf.queryExecution().optimizedPlan().toString().split("\n")
    product_join = next(i for i, row in enumerate(plan) if "Join" in row)
    assert not any("order_item_id" in row or "line_amount" in row for row in plan[product_join:])
