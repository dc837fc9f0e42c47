"""What the query data_tests stores and counts, and what it spares."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.helpers import duck, same
from tidemark.operators import checks
from tidemark.plans.build import Check, Model, failures, unique, unique_together, violations
from tidemark.plans.oracle import ORACLE_SQL
from tidemark.plans.queries import KEPT_FOR_TESTS, QUERIES
from tidemark.plans.warehouse import Warehouse
from tidemark.session import scratch


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_and_rows_are_counted_in_one_pass(spark):
    """Repeated keys are exact; a null single key is none; keys that differ by a microsecond differ."""
    at = datetime(2024, 1, 1)
    rows = [("a", at, 1), ("a", at + timedelta(microseconds=1), 2), ("b", at, 3), ("b", at, 4), (None, at, 5), (None, at, -6), (None, None, 7)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, n int")
    model = Model("m", "core", (), (unique("k"), unique_together("k", "at"), unique("n"), Check("negative", F.col("n") < 0), Check("any", find=lambda d, w: d.filter("n > 5"))))
    assert failures(df, model, None) == {"unique_k": 2, "unique_k_at": 2, "unique_n": 0, "negative": 1, "any": 1}
    assert failures(df, model, None, {"negative": 9})["negative"] == 9
    assert failures(df.limit(0), model, None) == dict.fromkeys(("unique_k", "unique_k_at", "unique_n", "negative", "any"), 0)
    assert {r["key"]: r["n"] for r in violations(df, model.checks[0], None).collect()} == {'{"k":"a"}': 2, '{"k":"b"}': 2}


def test_missing_keys_are_made_distinct_before_they_move(spark):
    source, target = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string"), spark.createDataFrame([("b",)], "k string")
    missing = checks.missing(source, target, "k")
    assert sorted(r["k"] or "" for r in missing.collect()) == ["", "a"]
    assert checks.missing(source, target.union(source.limit(1)).union(source.filter("k is null")), "k").isEmpty()
    tree = plan(missing).split("\n")
    assert next(i for i, row in enumerate(tree) if "Join" in row) < next(i for i, row in enumerate(tree) if "Aggregate" in row)


def test_stored_models_spare_the_feeds(spark, sf_dir):
    """What is made of stored models reads no feed but the customers' places; columns that weren't kept raise; nothing is left behind."""
    w, whole = Warehouse.over(spark, sf_dir), Warehouse.over(spark, sf_dir)
    with scratch(spark) as folder:
        w.store_versions(folder, KEPT_FOR_TESTS["orders_cdc"], KEPT_FOR_TESTS["latest"])
        w.store("order_items", folder, *KEPT_FOR_TESTS["order_items"])
        for name in ("orders_cdc", "status_history", "latest", "order_items"):
            found, expected = getattr(w, name), getattr(whole, name)
            assert found.schema.simpleString() == expected.schema.simpleString()
            assert "l_orderkey" not in plan(found) and "o_orderkey" not in plan(found)
        kept = {
            "orders_cdc": KEPT_FOR_TESTS["orders_cdc"],
            "latest": KEPT_FOR_TESTS["orders_cdc"] + KEPT_FOR_TESTS["latest"],
            "status_history": ("order_version_id", "order_id", "order_status", "valid_from", "is_current", "hours_in_status"),
        }
        for name, columns in kept.items():
            a, b = getattr(w, name).select(*columns), getattr(whole, name).select(*columns)
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
        with pytest.raises(Exception, match="courier is not kept"):
            w.latest.select("courier").collect()
        path = Path(folder.removeprefix("file:"))
        assert path.exists()
    assert not path.exists()


def test_a_product_listed_twice_counts_twice(spark, sf_dir, tmp_path):
    """Lines needn't move to their products only where no product is listed twice."""
    for table in Path(sf_dir).glob("*.parquet"):
        if table.name != "part.parquet":
            (tmp_path / table.name).symlink_to(table)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.unionByName(part.filter("p_partkey % 3 = 0")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for part_file in (tmp_path / "part.parquet").glob("*.parquet"):
        part_file.rename(tmp_path / "part.once")
    for rest in (tmp_path / "part.parquet").iterdir():
        rest.unlink()
    (tmp_path / "part.parquet").rmdir()
    (tmp_path / "part.once").rename(tmp_path / "part.parquet")
    assert any(r["failures"] for r in QUERIES["data_tests"](spark, str(tmp_path)).collect() if r["test"] == "kept_revenue_reconciles")
    same(QUERIES["data_tests"](spark, str(tmp_path)), duck(str(tmp_path)), ORACLE_SQL["data_tests"])
