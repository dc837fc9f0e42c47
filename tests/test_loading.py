import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.incremental import Versioned, delete_insert
from tidemark.plans.queries import QUERIES
from tidemark.plans.warehouse import Warehouse, clustered_increment, increment
from tidemark.schemas import RAW
from tidemark.session import REMOVAL, materialised, shuffles_removed
from tidemark.sources.clustered import FeedStore
from tidemark.sources.commits import CommitLog, ConflictError, Store
from tidemark.sources.freshness import freshness
from tidemark.sources.loader import Loader, last_run, published_days, run_results, write_daily
from tidemark.sources.tables import feeds
from tidemark.streaming.ingest import ingest, load_stream, order_stream

HEADER = ",".join(RAW["orders"].names)
ROW = "O{n},C1,HUB-1,Fast,UPI,2024-01-01 10:00:00,2024-01-08,created,,,,,2024-01-0{d} 10:00:00"


def land(landing, day, *rows):
    folder = landing / "orders" / f"dt=2024-01-0{day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "orders.csv").write_text("\n".join([HEADER, *rows]) + "\n")


def test_loads_are_incremental_and_idempotent(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, 1, ROW.format(n=1, d=1), ROW.format(n=2, d=1))
    land(landing, 2)
    (landing / "sellers.csv").write_text("seller_id,seller_name,hub_id,hub_state,onboarded_at\nS1,One,HUB-1,X,2023-01-01 00:00:00\n")
    loader = Loader(spark, str(landing), str(tmp_path / "raw"))
    first = loader.run()
    assert (first.files["orders"], first.rows["orders"], first.rows["sellers"], first.changed) == (2, 2, 1, [])
    assert json.loads(first.to_json())["load_id"] == first.load_id and "products" not in first.rows
    again = loader.run()
    assert (again.files["orders"], again.skipped["orders"]) == (0, 2)

    land(landing, 3, ROW.format(n=3, d=3))
    land(landing, 1, ROW.format(n=1, d=1))  # changed after it was loaded: told, not loaded again
    third = loader.run()
    assert (third.files["orders"], third.rows["orders"], third.changed) == (1, 1, ["orders/dt=2024-01-01/orders.csv"])
    table = loader.table("orders")
    assert table.count() == 3 and table.select("_load_id").distinct().count() == 2
    assert table.filter("order_id = 'O3'").first()["_source_file"] == "orders/dt=2024-01-03/orders.csv"
    assert table.filter("order_id = 'O3'").first()["purchase_at"] == datetime(2024, 1, 1, 10)
    assert loader.manifest().filter("rows_loaded = 0").count() == 1

    # a load that was never committed is not read
    table.limit(1).write.parquet(str(tmp_path / "raw/orders/data=lost"))
    assert loader.table("orders").count() == 3


def test_a_malformed_line_ends_the_load(spark, tmp_path):
    """Nothing of it is published; once the file is mended, the load runs as a whole."""
    landing = tmp_path / "landing"
    land(landing, 1, ROW.format(n=1, d=1))
    land(landing, 2, ROW.format(n=2, d=2), "O3,two,notatime,garbage")
    loader = Loader(spark, str(landing), str(tmp_path / "raw"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        loader.run()
    assert loader.manifest().isEmpty() and loader.table("orders").isEmpty()
    land(landing, 2, ROW.format(n=2, d=2))
    assert loader.run().rows["orders"] == 2 and loader.table("orders").count() == 2


def test_two_loaders_at_once_load_each_file_once(spark, tmp_path):
    """The second finds that the first has committed, plans anew, and has nothing left to do."""
    landing = tmp_path / "landing"
    land(landing, 1, ROW.format(n=1, d=1), ROW.format(n=2, d=1))
    other = Loader(spark, str(landing), str(tmp_path / "raw"))

    class Slow(Loader):
        tried = 0

        def commit_rows(self, entity, seen, written):
            self.tried += 1
            if self.tried == 1:
                assert other.run().rows["orders"] == 2
            super().commit_rows(entity, seen, written)

    slow = Slow(spark, str(landing), str(tmp_path / "raw"))
    report = slow.run()
    assert slow.tried == 1 and (report.files["orders"], report.skipped["orders"], report.rows["orders"]) == (0, 1, 0)
    assert slow.table("orders").count() == 2 and slow.manifest().count() == 1


def test_a_replayed_stream_loads_once(spark, tmp_path):
    """Killed between its commit and its checkpoint, the batch is run again and finds itself done; the rest equals a batch load."""
    landing, checkpoint = tmp_path / "landing", tmp_path / "checkpoint"
    land(landing, 1, ROW.format(n=1, d=1), ROW.format(n=2, d=1))
    loader = Loader(spark, str(landing), str(tmp_path / "raw"))
    load_stream(loader, "orders", str(checkpoint)).awaitTermination()
    assert loader.table("orders").count() == 2 and loader.manifest().first()["rows_loaded"] == 2
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink()
    land(landing, 2, ROW.format(n=3, d=2))
    load_stream(loader, "orders", str(checkpoint)).awaitTermination()
    assert sorted(r["order_id"] for r in loader.table("orders").collect()) == ["O1", "O2", "O3"]
    land(landing, 3, ROW.format(n=4, d=3))
    assert loader.run().files["orders"] == 1  # by the batch load; the stream then leaves it out
    load_stream(loader, "orders", str(checkpoint)).awaitTermination()
    land(landing, 1, ROW.format(n=9, d=1))
    assert loader.states("orders").filter("state = 'changed'").first()["file_path"] == "orders/dt=2024-01-01/orders.csv"
    whole = Loader(spark, str(landing), str(tmp_path / "other"))
    land(landing, 1, ROW.format(n=1, d=1), ROW.format(n=2, d=1))
    whole.run()
    columns = [*RAW["orders"].names, "_source_file"]
    assert sorted(map(str, loader.table("orders").select(columns).collect())) == sorted(map(str, whole.table("orders").select(columns).collect()))


def test_freshness_goes_by_the_clock(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 6),), (datetime(2024, 1, 2, 6),)], "_loaded_at timestamp_ntz")
    old, new, none = df.limit(1), df, df.limit(0)
    at = lambda x: {r["source"]: (r["days"], r["status"]) for r in freshness({"old": old, "new": new, "none": none}, x).collect()}
    assert at(F.lit(datetime(2024, 1, 4, 7))) == {"old": (3, "error"), "new": (2, "warn"), "none": (None, "error")}
    assert at(None) == {"old": (1, "warn"), "new": (0, "pass"), "none": (None, "error")}


def test_loads_go_in_steps(spark, tmp_path):
    landing = tmp_path / "landing"
    for day in range(1, 8):
        land(landing, day, ROW.format(n=day, d=day))
    loader = Loader(spark, str(landing), str(tmp_path / "raw"))
    loader.FILES = 3
    assert loader.run().rows["orders"] == 7 and loader.table("orders").select("_load_id").distinct().count() == 1
    assert len([k for k in loader.log.state().values if k.startswith("orders/")]) == 3


def test_commits_conflict_on_what_they_depend_on(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    seen = log.state()
    log.commit(seen, {"a": "1"})
    assert log.commit(seen, {"b": "1"}).values == {"a": "1", "b": "1"}  # takes the next number
    with pytest.raises(ConflictError):
        log.commit(seen, {"a": "2"})
    with pytest.raises(ConflictError):
        log.commit(seen, {"c": "2"}, depends=lambda k: k == "b")
    for i in range(45):
        log.commit(log.state(), {f"k{i % 7}": str(i)}, drop=("a",))
    assert log.state().values == {"b": "1", **{f"k{i % 7}": str(i) for i in range(45)}} and log.state().number == 47
    names = {p.name for p in (tmp_path / "log").iterdir() if p.suffix == ".state"}
    assert len(names) == 2


def test_many_writers_commit_one_after_another(spark, tmp_path):
    """Eight threads add to one counter; none of the additions is lost."""
    log = CommitLog(spark, str(tmp_path / "log"))

    def add(_):
        for _ in range(3):
            def attempt():
                seen = log.state()
                log.commit(seen, {"n": str(int(seen.values.get("n", "0")) + 1)})
            log.retried(attempt, times=100)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(8)))
    assert log.state().values["n"] == "24" and log.state().number == 24


def test_days_are_published_whole(spark, tmp_path, monkeypatch):
    """A writer that dies between days, or before it marks one, leaves nothing that is read or skipped by half."""
    df = spark.createDataFrame([(k, f"2024-01-0{d}") for d in (1, 2, 3, 4) for k in "ab"], "k string, day string")
    moved, path = Store.move, str(tmp_path / "orders")

    def dies(self, old, new):
        if new.endswith("03"):
            raise OSError("died")
        moved(self, old, new)

    monkeypatch.setattr(Store, "move", dies)
    with pytest.raises(OSError):
        write_daily(df, "day", str(tmp_path), "orders")
    assert published_days(spark, path) == ["2024-01-01", "2024-01-02"] and not [n for n in Store(spark, path).names(path) if n.startswith(".aside")]
    monkeypatch.undo()
    (tmp_path / "orders/dt=2024-01-02/_PUBLISHED").unlink()  # as if it had died before the mark
    loader = Loader(spark, str(tmp_path), str(tmp_path / "raw"), marked=True)
    assert loader.discover("orders").filter("file_path like '%02/%'").isEmpty() and not loader.discover("orders").isEmpty()
    assert write_daily(df, "day", str(tmp_path), "orders") == ["2024-01-02", "2024-01-03", "2024-01-04"]
    assert spark.read.option("header", True).csv(path).count() == 8 and len(published_days(spark, path)) == 4
    assert write_daily(df, "day", str(tmp_path), "orders") == []


def test_daily_sink_leaves_published_days_alone(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "k string, day string")
    write_daily(df, "day", str(tmp_path), "things")
    write_daily(df.unionByName(spark.createDataFrame([("c", "2024-01-03")], "k string, day string")), "day", str(tmp_path), "things")
    assert spark.read.option("header", True).csv(str(tmp_path / "things")).count() == 3


def test_stream_drops_copies(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, 1, ROW.format(n=1, d=1), ROW.format(n=1, d=1), ROW.format(n=2, d=1))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest(order_stream(spark, str(landing)), target, checkpoint).awaitTermination()
    land(landing, 2, ROW.format(n=1, d=1), ROW.format(n=4, d=2))
    ingest(order_stream(spark, str(landing)), target, checkpoint).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(target).select("order_id").collect()) == ["O1", "O2", "O4"]


def test_run_results(spark):
    document = {
        "metadata": {"invocation_id": "i", "generated_at": "2024-01-01T00:00:00Z"},
        "results": [{"unique_id": "model.x.y", "status": "success", "execution_time": 1.5, "adapter_response": {"rows_affected": 3}, "failures": None, "message": "OK"}],
    }
    rows = run_results(spark, json.dumps(document), "build")
    assert rows.first()["resource_type"] == "model" and last_run(rows).first()["n"] == 1


@pytest.mark.parametrize("split", ["1996-03-01", "1999-09-09"])
def test_incremental_fact_equals_full_build(spark, sf_dir, split):
    source = feeds(spark, sf_dir)
    early = F.col("_loaded_at") <= F.lit(split).cast("timestamp_ntz")
    target = materialised(Warehouse(replace(source, orders=source.orders.filter(early), payments=source.payments.filter(early))).fct_orders)
    full = materialised(Warehouse(source).fct_orders)
    rows, keys = increment(source, target)
    merged = materialised(delete_insert(target, rows, keys))
    assert merged.exceptAll(full).isEmpty() and full.exceptAll(merged).isEmpty()


def test_an_increment_of_few_orders_reads_few_files(spark, sf_dir, tmp_path):
    """One percent of the orders: less than a tenth of the files, and the fact is that of a full build."""
    source = feeds(spark, sf_dir)
    loads = source.orders.select("order_id", "_loaded_at").unionByName(source.payments.select("order_id", "_loaded_at"))
    last = [r["m"] for r in loads.groupBy("order_id").agg(F.max("_loaded_at").alias("m")).orderBy(F.desc("m")).limit(16).collect()]
    split = F.lit(last[-1]).cast("timestamp_ntz")
    late, early = (lambda df: df.filter(F.col("_loaded_at") > split)), (lambda df: df.filter(F.col("_loaded_at") <= split))
    before, after = (replace(source, orders=f(source.orders), payments=f(source.payments)) for f in (early, late))
    store = FeedStore(spark, str(tmp_path / "feeds"))
    store.add(before)
    target = materialised(Warehouse(before).fct_orders)
    done = target.withColumn("is_open", F.lit(False))  # orders that stay open would be looked at again
    store.add(replace(after, order_items=source.order_items.limit(0)))
    keys = materialised(store.affected(done))
    assert 0 < keys.count() <= 15
    cut = store.restricted(source, keys)
    for feed in ("orders", "order_items", "payments"):
        read, every = len(getattr(cut, feed).inputFiles()), len(store.read(feed).inputFiles())
        assert read < 0.1 * every, (feed, read, every)
    rows, changed = clustered_increment(store, source, target)
    merged, full = materialised(delete_insert(target, materialised(rows), changed)), materialised(Warehouse(source).fct_orders)
    assert merged.exceptAll(full).isEmpty() and full.exceptAll(merged).isEmpty()


def test_versions_are_replaced_by_partition(spark, tmp_path):
    """An increment writes the partitions it touches and leaves the others where they are."""
    store = Versioned(spark, str(tmp_path / "fact"), "k % 3")
    first = spark.range(30).selectExpr("id order_id", "id k", "'old' v")
    assert store.read() is None and store.publish(first).count() == 30
    before = store.current()
    rebuilt = materialised(spark.createDataFrame([(3, 3, "new"), (99, 99, "new")], "order_id long, k long, v string"))
    keys = materialised(spark.createDataFrame([(3,), (99,), (6,)], "order_id long"))
    now = store.replace(rebuilt, keys)
    assert {p for p, folder in store.current().items() if folder != before[p]} == {"0"}
    expected = [(i, i, "old") for i in range(30) if i not in (3, 6)] + [(3, 3, "new"), (99, 99, "new")]
    assert sorted(tuple(r) for r in now.collect()) == sorted(expected)
    assert store.vacuum(0) == 0 and store.publish(first.limit(3)).count() == 3
    assert store.vacuum(3600) == 0 and store.vacuum(0) == 2 and store.read().count() == 3


def shuffled(spark):
    """The files that this process keeps of what was shuffled, with their sizes."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p: p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


@pytest.mark.parametrize("name", ["clustered_incremental_fact", "incremental_fact"])
def test_a_maintained_fact_leaves_no_shuffles_behind_and_moves_no_stored_row(spark, sf_dir, name):
    """What a step has shuffled is gone once its result is stored, and then delete and insert go on where rows are."""
    key, removal = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get(REMOVAL)
    threshold, before = spark.conf.get(key), shuffled(spark)
    spark.conf.set(key, "-1")  # tables as small as these would be broadcast
    try:
        df = QUERIES[name](spark, sf_dir)
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, threshold)
    for _ in range(50):  # files are removed in the background; those of a few collected aggregates may stay
        left = sum(size for path, size in shuffled(spark).items() if path not in before)
        if left < 20_000:
            break
        time.sleep(0.2)
    assert left < 20_000 and spark.conf.get(REMOVAL) == removal
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]
    assert df.count() == 1500


def test_a_fact_by_steps_is_the_fact(spark, sf_dir, tmp_path):
    """Also with lines and payments of orders that aren't there, and orders without customers, lines or payments."""
    f = feeds(spark, sf_dir)
    number = F.col("order_id").cast("long")
    f = replace(
        f,
        orders=f.orders.filter(number % 5 != 0).withColumn("customer_id", F.when(number % 7 != 0, F.col("customer_id"))),
        order_items=f.order_items.filter(number % 3 != 0),
        payments=f.payments.filter(number % 4 != 0),
    )
    expected, found = materialised(Warehouse(f).fct_orders), materialised(Warehouse(f).fct_by_steps(str(tmp_path)))
    assert found.columns == expected.columns and found.count() == expected.count() > 1000
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_shuffles_are_removed_while_anyone_asks(spark):
    before = spark.conf.get(REMOVAL)
    with shuffles_removed(spark):
        with shuffles_removed(spark):
            assert spark.conf.get(REMOVAL) == "true"
        assert spark.conf.get(REMOVAL) == "true"
    assert spark.conf.get(REMOVAL) == before
