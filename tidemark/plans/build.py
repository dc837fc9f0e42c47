"""Building all models in order, with their data tests; what ran is kept as run results."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import cache, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import STATUS_RANK
from tidemark.operators import checks
from tidemark.operators.incremental import Versioned
from tidemark.plans import intermediate
from tidemark.plans.warehouse import Warehouse, increment
from tidemark.session import materialised
from tidemark.sources.commits import CommitLog, Staged, Table
from tidemark.sources.loader import RUN_RESULTS, is_missing
from tidemark.sources.tables import Feeds

#: How the models of a layer are kept: a view is planned into what reads it, a table is written and read.
KEPT = {"staging": "view", "intermediate": "table", "core": "table", "kpi": "table"}


def schema_name(custom: str | None, default: str = "main") -> str:
    """The schema of a model: the one its layer names, as it is, else the default one."""
    return custom.strip() if custom and custom.strip() else default


@dataclass(frozen=True)
class Check:
    """A data test. rows: a condition that no row may meet; all of a model's are counted while it is written. keys: columns that
    no two rows may share; all of a model's are found by one grouping. find: the violations as a table, for what takes
    more to see. A failed warning doesn't stop what is built on the model."""

    name: str
    rows: Column | None = None
    find: Callable[[DataFrame, Warehouse], DataFrame] | None = None
    severity: str = "error"
    keys: tuple[str, ...] = ()


def not_null(column: str) -> Check:
    return Check(f"not_null_{column}", F.col(column).isNull())


def unique(column: str) -> Check:
    return Check(f"unique_{column}", keys=(column,))


def unique_together(*columns: str) -> Check:
    return Check(f"unique_{'_'.join(columns)}", keys=columns)


def accepted(column: str, *values: str, severity: str = "error") -> Check:
    return Check(f"accepted_{column}", F.col(column).isNotNull() & ~F.col(column).isin(*values), severity=severity)


def positive(column: str) -> Check:
    return Check(f"positive_{column}", F.col(column) <= 0)


def between(column: str, least: float | None = None, most: float | None = None) -> Check:
    wrong = F.lit(False)
    if least is not None:
        wrong = wrong | (F.col(column) < least)
    if most is not None:
        wrong = wrong | (F.col(column) > most)
    return Check(f"between_{column}", wrong)


def in_order(earlier: str, later: str, where: str = "true", severity: str = "error") -> Check:
    return Check(f"order_{earlier}_{later}", F.expr(where) & (F.col(later) < F.col(earlier)), severity=severity)


def refers(column: str, model: str, to: str | None = None, severity: str = "error") -> Check:
    return Check(f"refers_{column}_{model}", find=lambda df, w: checks.relationships(df, column, getattr(w, model), to or column), severity=severity)


STATUSES = tuple(STATUS_RANK)


def reconciled(settings: intermediate.Settings = intermediate.Settings()) -> Check:
    """Settled orders that were kept, whose net revenue isn't their lines plus shipping."""
    gmv, cents = F.col("gross_merchandise_value"), "decimal(14,2)"
    shipping = F.when(gmv < F.lit(settings.free_shipping_from).cast(cents), F.lit(settings.shipping).cast(cents)).otherwise(F.lit(0).cast(cents))

    def find(df: DataFrame, w: Warehouse) -> DataFrame:
        newest = df.agg(F.max("delivered_at")).first()[0]
        if newest is None:
            return df.limit(0)
        settled = F.col("delivered_at") < F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {settings.settled_days} days")
        kept = df.filter((F.col("current_status") == "delivered") & settled & gmv.isNotNull())
        return kept.filter(F.abs(F.col("net_revenue") - (gmv + shipping)) > F.lit(settings.tolerance).cast("decimal(4,2)"))

    return Check("kept_revenue_reconciles", find=find)


def complete() -> Check:
    """Orders of the feed that don't reach the fact."""
    return Check("every_order_is_there", find=lambda df, w: checks.missing(w.feeds.orders, df, "order_id"))


def adds_up(column: str, expected: Callable[[DataFrame], Column]) -> Check:
    """A mart's column sums up to a count over the fact."""

    def find(df: DataFrame, w: Warehouse) -> DataFrame:
        whole = w.fct_orders.agg(expected(w.fct_orders).alias("whole"))
        return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("sum")).crossJoin(F.broadcast(whole)).filter("sum <> whole")

    return Check(f"{column}_adds_up", find=find)


@dataclass(frozen=True)
class Model:
    """A model: a property of Warehouse of that name, the models and feeds (feed:name) that it and its data tests read, and
    these tests."""

    name: str
    layer: str
    needs: tuple[str, ...] = ()
    checks: tuple[Check, ...] = field(default=())


@cache
def models() -> tuple[Model, ...]:
    """All models, each after those it needs (made when asked for, as columns need a session)."""
    every = lambda df: F.count("*")
    return (
        Model("orders_cdc", "staging", ("feed:orders",), (unique("order_version_id"), not_null("order_id"), not_null("updated_at"), accepted("order_status", *STATUSES), between("duplicate_copies_dropped", 0))),
        Model("customers_cdc", "staging", ("feed:customers", "feed:state_aliases"), (not_null("customer_id"), unique_together("customer_id", "updated_at"), Check("unmapped_state", ~F.col("is_state_mapped"), severity="warn"))),
        Model("order_items", "staging", ("feed:order_items",), (unique("order_item_id"), not_null("order_id"), positive("quantity"), positive("unit_price"))),
        Model("payments", "staging", ("feed:payments",), (unique("payment_id"), accepted("payment_type", "charge", "refund"), not_null("amount"))),
        Model("products", "staging", ("feed:products",), (unique("product_id"), not_null("product_id"))),
        Model("sellers", "staging", ("feed:sellers",), (unique("seller_id"), not_null("seller_id"))),
        Model("latest", "intermediate", ("orders_cdc",), (unique("order_id"), between("version_count", 1))),
        Model("status_history", "intermediate", ("orders_cdc",), (unique("order_version_id"), Check("one_current_row", find=lambda df, w: checks.one_current_row_per_key(df, "order_id", "is_current")), between("hours_in_status", 0))),
        Model("customers_scd2", "intermediate", ("customers_cdc",), (unique("customer_sk"), Check("one_current_row", find=lambda df, w: checks.one_current_row_per_key(df, "customer_id", "is_current")), Check("no_overlaps", find=lambda df, w: checks.scd2_no_overlaps(df, "customer_id", "valid_from", "valid_to")))),
        Model("items_by_order", "intermediate", ("order_items", "products"), (unique("order_id"), positive("item_count"))),
        Model("payments_by_order", "intermediate", ("payments",), (unique("order_id"), between("amount_refunded", 0))),
        Model("lifecycle", "intermediate", ("latest", "customers_scd2", "feed:orders", "feed:payments", "feed:ref_hubs", "feed:ref_states", "feed:sale_calendar"), (unique("order_id"), in_order("purchase_at", "approved_at"), in_order("approved_at", "shipped_at"), in_order("shipped_at", "delivered_at", "not has_timestamp_anomaly"))),
        Model("dim_geography", "core", ("feed:ref_states",), (unique("state"), between("remoteness_tier", 1, 3))),
        Model("dim_customers", "core", ("customers_scd2", "dim_geography"), (unique("customer_sk"), refers("state", "dim_geography"))),
        Model("dim_hubs", "core", ("sellers", "feed:ref_hubs"), (unique("hub_id"), between("seller_count", 0))),
        Model("dim_products", "core", ("products", "sellers"), (unique("product_id"), Check("seller_known", F.col("seller_name").isNull(), severity="warn"))),
        Model("dim_date", "core", ("feed:orders", "feed:sale_calendar"), (unique("date_key"), between("month_number", 1, 12), between("iso_day_of_week", 1, 7))),
        Model("fct_orders", "core", ("lifecycle", "items_by_order", "payments_by_order", "dim_date", "dim_customers", "feed:orders"), (unique("order_id"), accepted("current_status", *STATUSES), not_null("order_date_key"), refers("order_date_key", "dim_date", "date_key"), refers("customer_sk", "dim_customers"), between("days_late", 0), between("net_revenue", 0), complete(), reconciled())),
        Model("fct_order_items", "core", ("order_items", "fct_orders", "dim_products"), (unique("order_item_id"), refers("order_id", "fct_orders"), refers("product_id", "dim_products", severity="warn"))),
        Model("fct_order_status_history", "core", ("status_history", "fct_orders"), (unique("order_version_id"), refers("order_id", "fct_orders"))),
        Model("fulfillment_daily", "kpi", ("fct_orders",), (unique_together("order_date", "customer_state", "customer_region"), between("on_time_rate", 0, 1), adds_up("orders", every))),
        Model("state_scorecard", "kpi", ("fct_orders",), (unique("state"), accepted("sla_health", "healthy", "at risk", "critical"), adds_up("orders", every))),
        Model("courier_performance", "kpi", ("fct_orders",), (between("on_time_rate", 0, 1), adds_up("shipments", lambda df: F.count("shipped_at")))),
        Model("stage_bottlenecks", "kpi", ("fct_orders",), (unique("state"), positive("delivered_orders"))),
        Model("sale_event_impact", "kpi", ("fct_orders", "feed:sale_calendar"), (unique_together("sale_event", "start_date"), positive("orders_per_day"))),
        Model("order_funnel", "kpi", ("fct_orders",), (unique("order_month"), between("end_to_end_conversion", 0, 1), adds_up("placed", every))),
        Model("data_quality_daily", "kpi", ("orders_cdc", "latest", "feed:orders"), (unique("extract_date"), between("late_arrival_rate", 0, 1))),
    )


def _counted(check: Check, df: DataFrame, w: Warehouse) -> DataFrame:
    return check.find(df, w).agg(F.lit(check.name).alias("test"), F.count("*").alias("n"))


def _keyed(df: DataFrame, check: Check) -> DataFrame:
    """The rows that have a key: a null single key is no key."""
    return df if len(check.keys) > 1 else df.filter(F.col(check.keys[0]).isNotNull())


def _repeated(df: DataFrame, check: Check) -> DataFrame:
    """(test, key, n): the keys that more than one row has."""
    found = _keyed(df, check).groupBy(*check.keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    key = F.to_json(F.struct(*check.keys), {"ignoreNullFields": "false"})
    return found.select(F.lit(check.name).alias("test"), key.alias("key"), F.col("_n").alias("n"))


def _tallied(df: DataFrame, tests: list[Check], key: Check | None = None) -> DataFrame:
    """(test, n): the rows that meet each condition; with a key, in the same pass, how many 64-bit hashes of it more than one row has.
    Equal keys have equal hashes, so none means that no key is repeated."""
    met = [F.count_if(c.rows).alias(f"_c{i}") for i, c in enumerate(tests)]
    if key is None:
        sums, counts = [f"_c{i}" for i in range(len(tests))], df.agg(*met)
    else:
        hashed = F.xxhash64(*key.keys) if len(key.keys) > 1 else F.when(F.col(key.keys[0]).isNotNull(), F.xxhash64(*key.keys))
        by_hash = df.groupBy(hashed.alias("_hash")).agg(F.count("*").alias("_n"), *met)
        sums = [f"_c{i}" for i in range(len(tests) + 1)]
        whole = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums[:-1]]
        counts = by_hash.agg(*whole, F.count_if((F.col("_n") > 1) & F.col("_hash").isNotNull()).alias(sums[-1]))
    named = zip([c.name for c in tests] + ([key.name] if key else []), sums)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("test"), F.col(c).alias("n")) for name, c in named])))


def failures(df: DataFrame, model: Model, w: Warehouse, seen: dict[str, int] | None = None) -> dict[str, int]:
    """Violations of each data test of a model, by one job: one pass for all that rows can tell (none if `seen` has them from
    the write) and for a key, one for each further key, and what each other test takes, put together. Only keys of which hashes are
    repeated are grouped themselves, by a job more."""
    by_row, by_key = [c for c in model.checks if c.rows is not None and not (seen and c.name in seen)], [c for c in model.checks if c.keys]
    parts = [_counted(c, df, w) for c in model.checks if c.find is not None]
    if by_row or by_key:
        parts.append(_tallied(df, by_row, by_key[0] if by_key else None))
    parts += [_tallied(df, [], c) for c in by_key[1:]]
    found = {r["test"]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}
    found |= {c.name: _repeated(df, c).count() for c in by_key if found[c.name]}
    return {c.name: (seen or {}).get(c.name, found.get(c.name, 0)) for c in model.checks}


def violations(df: DataFrame, check: Check, w: Warehouse) -> DataFrame:
    """The rows (or keys, or findings) that fail a test."""
    if check.rows is not None:
        return df.filter(check.rows)
    return _repeated(df, check) if check.keys else check.find(df, w)


def suite(w: Warehouse, chosen: tuple[Model, ...] | None = None, threads: int = 4) -> list[tuple[str, str, str, int, str]]:
    """(model, test, severity, failures, status) of all data tests; some models are tested at once, so that the last tasks of one
    leave no workers idle."""
    among = chosen or models()
    made = [getattr(w, m.name) for m in among]
    with ThreadPoolExecutor(threads) as pool:
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(failures), df, m, w) for df, m in zip(made, among)]
    out = []
    for model, run in zip(among, running):
        found = run.result()
        out += [(model.name, c.name, c.severity, found[c.name], _status(c, found[c.name])) for c in model.checks]
    return out


def _status(check: Check, n: int) -> str:
    return "pass" if not n else "fail" if check.severity == "error" else "warn"


class BuildError(RuntimeError):
    """A model could not be built, or a data test failed."""


class _Feeds:
    """Feeds that tell a traced warehouse which of them are read."""

    def __init__(self, source: Feeds, w: Traced):
        self._source, self._w = source, w

    def __getattr__(self, name: str) -> DataFrame:
        self._w.note(f"feed:{name}")
        return getattr(self._source, name)


class Traced(Warehouse):
    """A warehouse that notes in `reads` what each model reads: models, and feeds as feed:name."""

    by_models = True

    def __init__(self, source: Feeds, among: tuple[Model, ...], **more):
        self.reads, self._among, self._at = {m.name: set() for m in among}, {m.name for m in among}, threading.local()
        super().__init__(source, **more)
        self.source, self.feeds = source, _Feeds(source, self)

    def note(self, name: str) -> None:
        if owner := getattr(self._at, "model", None):
            self.reads[owner].add(name)

    @contextmanager
    def within(self, model: str):
        before, self._at.model = getattr(self._at, "model", None), model
        try:
            yield
        finally:
            self._at.model = before

    def __getattribute__(self, name: str):
        own = object.__getattribute__
        shown = "fct_orders" if name == "stored_fact" else name
        if name.startswith("_") or shown not in own(self, "__dict__").get("_among", ()):
            return own(self, name)
        if getattr(self._at, "model", None) == shown:  # a model's own table
            return own(self, name)
        self.note(shown)
        with self.within(shown):
            return own(self, name)


def ordered(chosen: tuple[Model, ...]) -> tuple[Model, ...]:
    """Each model after those of the chosen ones that it needs; a cycle is an error."""
    left, out = {m.name: m for m in chosen}, []
    while left:
        free = [m for m in left.values() if not left.keys() & set(m.needs)]
        if not free:
            raise BuildError(f"models need each other: {', '.join(sorted(left))}")
        out += free
        for m in free:
            del left[m.name]
    return tuple(out)


def selected(chosen: tuple[Model, ...], selection: str) -> tuple[Model, ...]:
    """The models that a selection names: names or layers, parted by spaces; with + before it all that it needs too, with +
    behind it all that needs it."""
    by_name, out = {m.name: m for m in chosen}, set()

    def reach(start: set[str], step: Callable[[str], set[str]]) -> set[str]:
        found, todo = set(start), list(start)
        while todo:
            fresh = step(todo.pop()) - found
            found |= fresh
            todo += fresh
        return found

    for word in selection.split():
        name = word.strip("+")
        start = {m.name for m in chosen if name in (m.name, m.layer)}
        if not start:
            raise BuildError(f"no model or layer is called {name}")
        out |= start
        if word.startswith("+"):
            out |= reach(start, lambda n: set(by_name[n].needs) & by_name.keys())
        if word.endswith("+"):
            out |= reach(start, lambda n: {m.name for m in chosen if n in m.needs})
    return tuple(m for m in chosen if m.name in out)


_RESULTS = RUN_RESULTS.replace("timestamp", "timestamp_ntz")
_FAILURES = "invocation_id string, test string, row string"


class Builder:
    """Builds the models under a root folder: <root>/<schema>/<model>, and <root>/ops with run results and failing rows.

    A model is written to a folder of its own and becomes current by a commit of <root>/_log, after its data tests: readers have
    the former state meanwhile, and keep it if a test or the build fails.
    """

    def __init__(self, spark: SparkSession, root: str, kept: dict[str, str] | None = None, threads: int = 4):
        self.spark, self.root, self.kept, self.models, self.threads = spark, root.rstrip("/"), KEPT | (kept or {}), models(), threads
        self.log = CommitLog(spark, f"{self.root}/_log")
        self.fact = Versioned(spark, self.path("core", "fct_orders"), "date_format(order_date, 'yyyy-MM')", self.log, "core.fct_orders")

    def path(self, layer: str, name: str) -> str:
        return f"{self.root}/{schema_name(layer)}/{name}"

    def table(self, model: Model) -> Table:
        if model.name == "fct_orders":
            return self.fact
        return Table(self.log, self.spark, self.path(model.layer, model.name), f"{schema_name(model.layer)}.{model.name}")

    def _staged(self, model: Model, w: Traced, full_refresh: bool, seen: dict[str, int]) -> tuple[DataFrame, Staged | None]:
        """The model as its tests and what is built on it read it, and what makes it current. `seen` takes the violations that
        were counted while it was written."""
        if model.name == "fct_orders" and not full_refresh and (stored := self.fact.read()) is not None:
            rows, keys = increment(w.source, stored, w.settings)
            staged = self.fact.stage_replace(materialised(rows), keys)
            return self.fact.read(staged=staged), staged
        df = getattr(w, model.name)
        if self.kept[model.layer] == "view":
            return df, None
        by_row, table = [c for c in model.checks if c.rows is not None], self.table(model)
        if not by_row:
            staged = table.stage(df)
            return table.read(staged=staged), staged
        watch = Observation(f"{model.name}-{uuid.uuid4().hex}")
        staged = table.stage(df.observe(watch, *[F.count_if(c.rows).alias(f"c{i}") for i, c in enumerate(by_row)]))
        counted = watch.get
        seen |= {c.name: counted.get(f"c{i}") or 0 for i, c in enumerate(by_row)}
        return table.read(staged=staged), staged

    def run(self, source: Feeds, full_refresh: bool = False, tests: bool = True, command: str = "build", select: str | None = None) -> Warehouse:
        """Builds, tests and publishes each model after those it needs, several at once where none needs another.

        select: the models to build (see `selected`); others are read as they are stored. What needs a model that failed is
        skipped and stays as it was. Run results and failing rows are kept in any case; a failure of severity error raises
        BuildError in the end.
        """
        chosen = ordered(self.models if select is None else selected(self.models, select))
        w = Traced(source, self.models)
        if select is not None:
            self._stored_for(chosen, w)
        invocation, began = uuid.uuid4().hex, datetime.now(UTC).replace(tzinfo=None)
        broken: set[str] = set()
        results: list[tuple] = []

        def note(kind: str, name: str, status: str, since: float, rows: int | None = None, failed: int | None = None, message: str | None = None) -> None:
            results.append((invocation, command, began, f"{kind}.{name}", kind, status, time.perf_counter() - since, rows, failed, message))

        def one(model: Model) -> None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", model.name)
            since = time.perf_counter()
            if blocked := sorted(broken.intersection(model.needs)):
                broken.add(model.name)
                note("model", model.name, "skipped", since, message=f"needs {', '.join(blocked)}")
                return
            seen: dict[str, int] = {}
            try:
                df, staged = self._staged(model, w, full_refresh, seen)
                if undeclared := sorted(w.reads[model.name] - set(model.needs) - {model.name}):
                    raise BuildError(f"{model.name} reads {', '.join(undeclared)}, which it doesn't say that it needs")
                rows = None if staged is None else df.count()
                note("model", model.name, "success", since, rows)
            except Exception as e:  # one model's failure is a result like any other
                broken.add(model.name)
                note("model", model.name, "error", since, message=str(e)[:500])
                return
            w.__dict__[model.name] = df  # what comes later reads what was kept
            if model.name == "fct_orders":
                w.__dict__["stored_fact"] = df
            if tests and model.checks:
                self._test(model, df, w, seen, note, broken, invocation)
            if staged is not None and model.name not in broken:
                since = time.perf_counter()
                try:
                    self.table(model).commit(staged)
                except Exception as e:
                    broken.add(model.name)
                    note("publication", model.name, "error", since, message=str(e)[:500])

        try:
            self._in_order(chosen, one)
        finally:
            if results:
                rows = self.spark.createDataFrame(results, _RESULTS)
                rows.coalesce(1).write.mode("append").parquet(f"{self.root}/ops/run_results")
        if wrong := [f"{r[3]}: {r[9] or f'{r[8]} violations'}" for r in results if r[5] in ("error", "fail")]:
            raise BuildError("; ".join(wrong))
        return w

    def _test(self, model: Model, df: DataFrame, w: Traced, seen: dict[str, int], note: Callable, broken: set[str], invocation: str) -> None:
        """Notes each test's result; if they can't be told together, each on its own. Failing rows are stored."""
        since = time.perf_counter()
        try:
            with w.within(model.name):
                found: dict[str, int | Exception] = dict(failures(df, model, w, seen))
        except Exception:
            found = {}
            for c in model.checks:
                try:
                    found[c.name] = failures(df, replace(model, checks=(c,)), w, seen)[c.name]
                except Exception as e:
                    found[c.name] = e
        for c in model.checks:
            n, name = found[c.name], f"{model.name}.{c.name}"
            status = "error" if isinstance(n, Exception) else _status(c, n)
            note("test", name, status, since, failed=None if status == "error" else n, message=str(n)[:500] if status == "error" else None)
            since = time.perf_counter()
            if status in ("fail", "error"):
                broken.add(model.name)
            if status in ("fail", "warn"):
                rows = violations(df, c, w).select(F.lit(invocation).alias("invocation_id"), F.lit(name).alias("test"), F.to_json(F.struct("*")).alias("row"))
                rows.write.mode("append").parquet(f"{self.root}/ops/failures")

    def _in_order(self, chosen: tuple[Model, ...], one: Callable[[Model], None]) -> None:
        """one(model) of all, each after those it needs, up to `threads` at once. In a session with
        spark.scheduler.mode FAIR their jobs share the executors evenly."""
        left = {m.name: m for m in chosen}
        running: dict[Future, str] = {}
        with ThreadPoolExecutor(self.threads) as pool:
            while left or running:
                ahead = left.keys() | set(running.values())
                for m in [m for m in left.values() if not ahead & set(m.needs)]:
                    running[pool.submit(inheritable_thread_target(self.spark)(one), m)] = left.pop(m.name).name
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for f in done:
                    del running[f]
                    f.result()

    def _stored_for(self, chosen: tuple[Model, ...], w: Traced) -> None:
        """Lets w read the tables that are built on by the chosen models, but not built."""
        names = {m.name for m in chosen}
        for m in self.models:
            if m.name not in names and self.kept[m.layer] != "view" and (stored := self.table(m).read()) is not None:
                w.__dict__[m.name] = stored
                if m.name == "fct_orders":
                    w.__dict__["stored_fact"] = stored

    def _ops(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/ops/{name}")
        except Exception as e:
            if is_missing(e):
                return None
            raise

    def results(self) -> DataFrame | None:
        return self._ops("run_results", _RESULTS)

    def failing_rows(self) -> DataFrame | None:
        """(invocation_id, test, row as JSON) of tests that failed or warned."""
        return self._ops("failures", _FAILURES)

    def paths(self) -> dict[str, list[str]]:
        """The folders of the stored tables by schema.name, of one state; those that were not built yet are left out."""
        now = Staged(self.log.state(), {})
        found = {f"{schema_name(m.layer)}.{m.name}": self.table(m).paths(staged=now) for m in self.models if self.kept[m.layer] != "view"}
        return {name: paths for name, paths in found.items() if paths}

    def stored(self) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(*there) for name, there in self.paths().items()}

    def vacuum(self, age: float = 7 * 86400) -> int:
        """Removes what was replaced longer ago than `age` seconds; says how many folders."""
        return sum(self.table(m).vacuum(age) for m in self.models if self.kept[m.layer] != "view")

    def catalogue(self) -> DataFrame:
        """(table, rows, columns) of the stored tables, from Parquet footers."""
        rows = [(name, df.count(), len(df.columns)) for name, df in self.stored().items()]
        return self.spark.createDataFrame(rows, "table string, rows long, columns int")
