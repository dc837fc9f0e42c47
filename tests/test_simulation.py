import math
from dataclasses import replace
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.cli import Project
from tidemark.plans.build import Builder, BuildError, Check, Model, Traced, ordered, schema_name, selected, suite
from tidemark.plans.warehouse import Warehouse
from tidemark.session import materialised
from tidemark.sources.commits import CommitLog
from tidemark.sources.schedule import Daily, Runs, Sensor
from tidemark.sources.seed_files import SEEDS, alias_table, load_seeds
from tidemark.sources.simulate import COURIERS, REGIONS, Plan, Simulator

SMALL = Plan(start=date(2024, 2, 1), end=date(2024, 2, 16), orders_per_day=12, seed=3, customers=150, products=40, sellers=9)


@pytest.fixture(scope="module")
def half_year(spark):
    """The orders of half a year, stored."""
    return Simulator(spark, Plan(start=date(2024, 1, 1), end=date(2024, 6, 30), orders_per_day=60, seed=5, customers=900))


@pytest.fixture(scope="module")
def orders(half_year, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    half_year.orders().write.mode("overwrite").parquet(path)
    return half_year.spark.read.parquet(path)


def test_poisson_counts(spark):
    """Mean, spread and the chance of none are those of the distribution, also for means beyond one part."""
    s = Simulator(spark, SMALL)
    k = F.col("id")
    row = spark.range(20_000).select(s.poisson("a", F.lit(2.5), k).alias("a"), s.poisson("b", F.lit(900.0), k).alias("b")).agg(
        F.avg("a"), F.var_samp("a"), F.avg((F.col("a") == 0).cast("int")), F.avg("b"), F.var_samp("b")
    ).first()
    assert row[0] == pytest.approx(2.5, abs=0.05) and row[1] == pytest.approx(2.5, abs=0.12) and row[2] == pytest.approx(math.exp(-2.5), abs=0.01)
    assert row[3] == pytest.approx(900, abs=1) and row[4] == pytest.approx(900, rel=0.05)


def test_parcels_go_from_the_first_sellers_hub(half_year, orders):
    first = half_year.order_items().filter("order_item_seq = 1").join(half_year.sellers(), "seller_id").select("order_id", F.col("hub_id").alias("from_hub"))
    assert orders.join(first, "order_id").filter("hub_id <> from_hub").isEmpty() and first.count() == orders.count()


def test_parcels_go_to_the_address_at_purchase(half_year, orders):
    """The tier of an order is that of its customer's version valid then, as the warehouse finds it."""
    versions = half_year.customers().withColumn("alias", F.lower(F.trim("state"))).drop("state").join(half_year.aliases(), "alias")
    moved = versions.groupBy("customer_id").agg(F.max("updated_at").alias("since"), F.max_by("state", "updated_at").alias("state"), F.count("*").alias("n")).filter("n = 2")
    met = orders.join(moved, "customer_id").filter("purchase_at >= since").join(half_year.states, "state")
    assert met.count() > 0 and met.filter("tier <> remoteness_tier").isEmpty()


def hours(start, end):
    return F.avg((F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))) / 3600)


def test_what_makes_parcels_slow(orders):
    """Distance, remoteness, cash on delivery, unreliable couriers and congestion all tell."""
    transit = hours("shipped_at", "arrived_at")
    mean = lambda condition, what=transit: orders.filter(condition).agg(what).first()[0]
    assert mean("distance > 7") > mean("distance < 3") + 20
    assert mean("tier = 3") > mean("tier = 1") + 15
    assert mean("courier = 'Budget'") > mean("courier = 'Swift'") + 15
    approval = hours("purchase_at", "approved_at")
    assert mean("payment_method = 'COD'", approval) > 1.4 * mean("payment_method <> 'COD'", approval)
    assert mean("congestion > 1.5", approval) > mean("congestion < 1.1", approval) + 1
    assert {r["courier"] for r in orders.select("courier").distinct().collect()} == {c[0] for c in COURIERS}


def test_service_is_calibrated(orders):
    """Most parcels are on time, some are not, and each outcome has about its share."""
    late = orders.filter("arrived_at is not null").agg(F.avg((F.col("arrived_at").cast("date") > F.col("estimated_delivery_date")).cast("int"))).first()[0]
    assert 0.05 < late < 0.45
    n = {r["outcome"]: r["count"] / orders.count() for r in orders.groupBy("outcome").count().collect()}
    assert n["cancelled"] == pytest.approx(0.03, abs=0.012) and n["rto"] == pytest.approx(0.022, abs=0.012) and n["returned"] == pytest.approx(0.045, abs=0.015)
    by_day = orders.groupBy(F.col("purchase_at").cast("date").alias("d")).count()
    usual, busy = (by_day.filter(c).agg(F.avg("count")).first()[0] for c in ("d < '2024-02-09'", "d between '2024-02-09' and '2024-02-15'"))
    assert busy > 1.2 * usual


def test_a_run_depends_on_its_seed_alone(spark):
    one, same, other = (Simulator(spark, Plan(**{**vars(SMALL), "seed": seed})).payments() for seed in (3, 3, 4))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(same) != rows(other)


def test_aliases_know_each_spelling(spark):
    s = Simulator(spark, SMALL)
    known = {r["alias"]: r["state"] for r in s.aliases().collect()}
    assert known["northmark"] == known["s00"] == known["nothmark"] == known["norrthmark"] == known["nort-hmark"] == known["northmark st"] == "Northmark"
    spelt = [r["state"] for r in s.customers().select("state").distinct().collect()]
    assert all(x.strip().lower() in known for x in spelt)
    states = spark.createDataFrame([("Aa", "bb", "R", 1), ("Bb", "cc", "R", 1)], SEEDS["ref_states"])
    wrong = spark.createDataFrame([(" CC ", "Aa"), ("bbb", "Bb")], "alias string, state string")
    assert {(r["alias"], r["state"]) for r in alias_table(states, wrong).collect()} == {("aa", "Aa"), ("bb", "Bb"), ("cc", "Bb"), ("bbb", "Bb")}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    """Half of the plan released, loaded and built; then the rest."""
    p = Project(spark, str(tmp_path_factory.mktemp("project")), SMALL)
    p.generate(date(2024, 2, 9))
    p.load()
    p.transform()
    p.first = p.builder.fact.current()
    p.fact = p.advance(100)
    return p


def test_an_increment_equals_a_full_build(project):
    full = materialised(Warehouse(project.feeds()).fct_orders)  # later loads replace the snapshots it reads
    assert project.fact.count() == full.count() and project.fact.exceptAll(full).isEmpty()
    assert project.load().files == {e: 0 for e in ("orders", "order_items", "payments", "customers")}
    newest = project.loader.manifest().select(F.max("file_path")).first()[0]
    assert project.advance(5).count() == full.count() and newest
    again = project.transform(full_refresh=True)
    assert again.exceptAll(full).isEmpty() and again.count() == full.count()


def test_tables_results_and_status(project):
    status = project.status()
    assert {r["entity"] for r in status["loads"].collect()} == {"orders", "order_items", "payments", "customers"}
    tables = {r["table"]: r["rows"] for r in status["tables"].collect()}
    assert len(tables) == 21 and tables["core.fct_orders"] == project.fact.count() > 0 and tables["kpi.state_scorecard"] > 0
    last = {r["status"]: r["n"] for r in status["last run"].collect()}
    assert last["success"] == 27 and last["pass"] > 50 and "fail" not in last
    results = project.builder.results()
    assert results.select("invocation_id").distinct().count() >= 2
    assert results.filter("unique_id = 'test.fct_orders.every_order_is_there' and failures = 0").count() >= 2


def test_questions_are_answered_read_only_and_kept(project):
    now = [0.0]
    desk = project.desk()
    desk.clock = lambda: now[0]
    sql = "select courier, count(*) n from core_fct_orders where array_contains(:regions, customer_region) group by 1 order by 1"
    found = desk.ask(sql, regions=["North", "South"])
    assert found["n"].sum() == project.fact.filter("customer_region in ('North', 'South')").count()
    assert desk.ask(sql, regions=["North", "South"]) is found
    now[0] = 301.0
    assert desk.ask(sql, regions=["North", "South"]) is not found
    for wrong in ("drop view core_fct_orders", "select 1; select 2", "insert into x select 1"):
        with pytest.raises(ValueError):
            desk.ask(wrong)
    desk.most = 3
    with pytest.raises(ValueError, match="aggregate"):
        desk.ask("select * from kpi_fulfillment_daily")


def test_a_red_test_stops_what_is_built_on_it(spark, project, tmp_path):
    """The models after it are skipped, results are kept, and the build fails; a warning stops nothing."""
    builder = Builder(spark, str(tmp_path))
    red, warn = (Check(f"none_{s}", F.lit(True), severity=s) for s in ("error", "warn"))
    builder.models = (
        Model("sellers", "staging", ("feed:sellers",), (warn,)),
        Model("dim_hubs", "core", ("sellers", "feed:ref_hubs"), (red,)),
        Model("dim_geography", "core", ("dim_hubs", "feed:ref_states")),
        Model("products", "staging", ("feed:products",)),
        Model("nothing", "kpi", ("products",)),
    )
    with pytest.raises(BuildError, match="dim_hubs.none_error"):
        builder.run(project.feeds())
    found = {r["unique_id"]: r["status"] for r in builder.results().collect()}
    assert found == {
        "model.sellers": "success", "test.sellers.none_warn": "warn", "model.dim_hubs": "success", "test.dim_hubs.none_error": "fail",
        "model.dim_geography": "skipped", "model.products": "success", "model.nothing": "error",
    }


def test_results_and_tables_survive_what_raises(spark, project, tmp_path):
    """A feed whose rows raise, a test that raises and a write that dies: results are kept, and readers have what was there."""
    builder = Builder(spark, str(tmp_path))
    hubs = Model("dim_hubs", "core", ("sellers", "feed:ref_hubs"), (Check("hub_is_there", F.col("hub_id").isNull()),))
    builder.models = (Model("sellers", "staging", ("feed:sellers",)), hubs)
    builder.run(project.feeds())
    before, held = builder.stored()["core.dim_hubs"].count(), builder.stored()["core.dim_hubs"]
    assert before > 0 and builder.failing_rows() is None

    raising = replace(project.feeds(), sellers=project.feeds().sellers.withColumn("seller_name", F.raise_error(F.lit("no such seller")).cast("string")))
    bad = Check("raises", find=lambda df, w: df.filter(F.raise_error(F.lit("a test raised")).isNotNull()))
    builder.models = (Model("sellers", "staging", ("feed:sellers",), (Check("unnamed", F.col("seller_name").isNull()), bad)), hubs)
    with pytest.raises(BuildError, match="no such seller"):
        builder.run(raising)
    last = builder.results().orderBy(F.desc("generated_at")).first()["invocation_id"]
    found = {r["unique_id"]: r["status"] for r in builder.results().filter(F.col("invocation_id") == last).collect()}
    assert found["test.sellers.unnamed"] == "error" and found["model.dim_hubs"] == "skipped"

    red = Check("red", F.col("hub_id") == held.first()["hub_id"])
    builder.models = (Model("sellers", "staging", ("feed:sellers",)), replace(hubs, checks=(red,)))
    with pytest.raises(BuildError, match="dim_hubs.red: [12] violations"):
        builder.run(replace(project.feeds(), ref_hubs=project.feeds().ref_hubs.limit(1).unionByName(project.feeds().ref_hubs)))
    assert builder.stored()["core.dim_hubs"].count() == before and held.count() == before
    assert {r["test"] for r in builder.failing_rows().collect()} == {"dim_hubs.red"}

    table = builder.table(hubs)
    with pytest.raises(Exception, match="died"):
        table.publish(held.withColumn("hub_id", F.when(F.rand() < 2, F.raise_error(F.lit("died"))).cast("string")))
    assert table.read().count() == before
    assert builder.vacuum(3600) == 0 and builder.vacuum(0) >= 1 and builder.stored()["core.dim_hubs"].count() == before


def test_the_graph_is_what_models_read(spark, project):
    """What each model reads, recorded while it is planned, is what it says that it needs, but for what its tests read."""
    w = Traced(project.feeds(), project.builder.models)
    for m in project.builder.models:
        getattr(w, m.name)
        assert w.reads[m.name] <= set(m.needs), m.name
        assert set(m.needs) - w.reads[m.name] <= {"dim_date", "dim_customers", "fct_orders", "dim_products", "dim_geography", "feed:orders"}, m.name
    with pytest.raises(BuildError, match="need each other"):
        ordered((Model("a", "core", ("b",)), Model("b", "core", ("a",))))
    names = lambda s: {m.name for m in selected(project.builder.models, s)}
    assert names("latest") == {"latest"} and names("+latest") == {"latest", "orders_cdc"}
    assert names("dim_hubs+") == {"dim_hubs"} and names("stage_bottlenecks order_funnel") == {"stage_bottlenecks", "order_funnel"}
    assert names("fct_orders+") == {"fct_orders", "fct_order_items", "fct_order_status_history", *(m.name for m in project.builder.models if m.layer == "kpi" and m.name != "data_quality_daily")}
    with pytest.raises(BuildError, match="called"):
        names("nothing")


def test_the_project_watches_and_takes_results(project, tmp_path):
    assert project.watch(seconds=0, times=2) == 1
    assert {r["source"]: r["status"] for r in project.freshness().collect()}.keys() == {"orders", "order_items", "payments", "customers"}
    (tmp_path / "r.json").write_text('{"metadata": {"invocation_id": "i", "generated_at": "2024-01-01T00:00:00Z"}, "results": [{"unique_id": "model.x", "status": "success"}]}')
    assert project.take_results(str(tmp_path / "r.json")) == 1
    assert project.builder.results().filter("invocation_id = 'i'").first()["command"] == "imported"


def test_a_part_of_the_graph_is_built_alone(project):
    before = project.builder.paths()
    project.builder.run(project.feeds(), select="order_funnel stage_bottlenecks")
    after = project.builder.paths()
    assert {n for n in after if after[n] != before[n]} == {"kpi.order_funnel", "kpi.stage_bottlenecks"}


def test_two_sensors_start_one_run(project, tmp_path):
    log, now, ran = CommitLog(project.spark, str(tmp_path / "runs")), [1000.0], []
    one, two = (Sensor(project.loader, Runs(log, lease=60, now=lambda: now[0]), running=True) for _ in range(2))

    def work():
        ran.append(1)
        assert two.tick(lambda: ran.append("twice")) is False  # while the first is at it

    assert one.tick(work) is True and ran == [1]
    assert one.tick(work) is False and two.tick(work) is False  # nothing new
    # a run that died is taken over when its lease is out
    runs = Runs(log, lease=60, now=lambda: now[0])
    with pytest.raises(KeyboardInterrupt):
        runs.once("k", lambda: (_ for _ in ()).throw(KeyboardInterrupt()))
    assert Runs(log, 60, lambda: now[0]).once("k", lambda: ran.append(2)) is False
    now[0] += 61
    assert Runs(log, 60, lambda: now[0]).once("k", lambda: ran.append(2)) is True and ran[-1] == 2
    with pytest.raises(ZeroDivisionError):
        runs.once("fails", lambda: 1 / 0)
    assert runs.get("fails")["state"] == "failed" and runs.once("fails", lambda: ran.append(3)) is True
    daily, at = Daily(time(6, 0), "UTC", running=True), datetime(2024, 1, 2, 7, 0, tzinfo=ZoneInfo("UTC"))
    assert daily.tick(runs, at, lambda: ran.append(4)) and not daily.tick(runs, at + timedelta(hours=5), lambda: ran.append(5)) and ran[-1] == 4
    assert Daily().tick(runs, at, lambda: ran.append(6)) is False


def test_suite_finds_planted_faults(spark, project):
    w = Warehouse(project.feeds())
    fact = project.fact
    w.__dict__["fct_orders"] = fact.unionByName(fact.limit(1)).withColumn("net_revenue", F.when(F.col("order_id") == fact.first()["order_id"], -1).otherwise(F.col("net_revenue")).cast("decimal(14,2)"))
    models = tuple(m for m in Builder(spark, "unused").models if m.name == "fct_orders")
    found = {test: (n, status) for _, test, _, n, status in suite(w, models)}
    assert found["unique_order_id"] == (1, "fail") and found["between_net_revenue"][1] == "fail" and found["every_order_is_there"] == (0, "pass")


def test_seed_files_have_their_types(project, spark, tmp_path):
    seeds = load_seeds(spark, f"{project.root}/seeds")
    assert dict(seeds["sale_calendar"].dtypes) == {"sale_event": "string", "start_date": "date", "end_date": "date"}
    assert seeds["ref_states"].agg(F.sum("remoteness_tier")).first()[0] == sum(t for many in REGIONS.values() for _, t, _, _ in many)
    for name, kinds in SEEDS.items():
        (tmp_path / f"{name}.csv").write_text(",".join(f.split()[0] for f in kinds.split(", ")) + "\nX,Y,Z,far\n" * (name == "ref_states"))
    with pytest.raises(Exception, match="MALFORMED"):
        load_seeds(spark, str(tmp_path))["ref_states"].collect()


def test_extracts_are_sorted(project, spark):
    rows = spark.read.option("header", True).csv(f"{project.root}/landing/orders/dt=2024-02-05")
    times = [r["updated_at"] for r in rows.withColumn("f", F.col("_metadata.file_path")).filter(F.col("f") == rows.select("_metadata.file_path").first()[0]).collect()]
    assert times == sorted(times) and times


def test_sensor_and_schedule(project):
    sensor = Sensor(project.loader)
    assert sensor.look(None)[0] is False  # not started
    sensor.running = True
    due, cursor = sensor.look(None)
    assert due and sensor.look(cursor) == (False, cursor)
    utc = ZoneInfo("UTC")
    assert Daily().next(datetime(2024, 1, 1, tzinfo=utc)) is None
    daily = Daily(time(6, 0), "Asia/Kolkata", running=True)
    assert daily.next(datetime(2024, 1, 1, 0, 29, tzinfo=utc)).astimezone(utc) == datetime(2024, 1, 1, 0, 30, tzinfo=utc)
    assert daily.next(datetime(2024, 1, 1, 0, 30, tzinfo=utc)).astimezone(utc) == datetime(2024, 1, 1, 0, 30, tzinfo=utc) + timedelta(1)
    assert schema_name("kpi") == "kpi" and schema_name(None) == schema_name(" ") == "main"
