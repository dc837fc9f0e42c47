"""All models over one set of feeds, built when first asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import affected, restricted
from tidemark.operators.versions import history_columns, is_last, latest_version, status_history
from tidemark.plans import core, intermediate, marts, staging
from tidemark.session import dealt, materialised, scratch, unkept, written
from tidemark.sources.clustered import FeedStore
from tidemark.sources.tables import Feeds, feeds


def _in_schema_of(df: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with the columns of df; those that aren't there raise if they are read."""
    return kept.select([f.name if f.name in kept.columns else unkept(f.name, f.dataType) for f in df.schema])


class Warehouse:
    """Each model is a lazy DataFrame: a query plans (and reads) only what it needs."""

    #: Whether each model is made of the models that it names alone.
    by_models = False

    def __init__(self, source: Feeds, settings: intermediate.Settings = intermediate.Settings(), clock: DataFrame | None = None):
        """clock: rows whose newest updated_at is now; the order feed itself, unless that is a part of one."""
        self.feeds, self.settings, self.clock = source, settings, source.orders if clock is None else clock

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Warehouse:
        return cls(feeds(spark, sf_dir))

    def store(self, name: str, folder: str, *columns: str) -> None:
        """Has a model computed once, into a folder, for what is made of it from now on. With columns, these alone are kept."""
        df = getattr(self, name)
        self.__dict__[name] = _in_schema_of(df, written(df.select(*columns) if columns else df, f"{folder}/{name}"))

    def store_versions(self, folder: str, columns: tuple[str, ...], of_latest: tuple[str, ...]) -> None:
        """As `store`, orders_cdc with these columns and, from the same sort, status_history as far as they go, and latest with the
        columns `of_latest` beside them, which other versions leave empty."""
        made = {"orders_cdc": self.orders_cdc, "status_history": self.status_history, "latest": self.latest}
        added = history_columns()
        history = ["is_current", "hours_in_status"]
        rows = self.orders_cdc.select(*columns, *of_latest, *[added[n].alias(n) for n in history], is_last().alias("_last"))
        rows = rows.withColumns({c: F.when(F.col("_last"), F.col(c)) for c in of_latest})
        kept = written(rows, f"{folder}/orders_cdc")
        stored = {
            "orders_cdc": kept.select(*columns),
            "status_history": kept.select("order_version_id", "order_id", "order_status", F.col("updated_at").alias("valid_from"), *history),
            "latest": kept.filter("_last").select(*columns, *of_latest),
        }
        self.__dict__.update({n: _in_schema_of(df, stored[n]) for n, df in made.items()})

    @cached_property
    def orders_cdc(self) -> DataFrame:
        return staging.orders_cdc(self.feeds.orders)

    @cached_property
    def customers_cdc(self) -> DataFrame:
        return staging.customers_cdc(self.feeds.customers, self.feeds.state_aliases)

    @cached_property
    def order_items(self) -> DataFrame:
        return staging.order_items(self.feeds.order_items)

    @cached_property
    def payments(self) -> DataFrame:
        return staging.payments(self.feeds.payments)

    @cached_property
    def products(self) -> DataFrame:
        return staging.products(self.feeds.products)

    @cached_property
    def sellers(self) -> DataFrame:
        return staging.sellers(self.feeds.sellers)

    @cached_property
    def latest(self) -> DataFrame:
        return latest_version(self.orders_cdc)

    @cached_property
    def status_history(self) -> DataFrame:
        return status_history(self.orders_cdc)

    @cached_property
    def customers_scd2(self) -> DataFrame:
        return intermediate.customers_scd2(self.customers_cdc)

    @cached_property
    def items_by_order(self) -> DataFrame:
        return intermediate.items_by_order(self.order_items, self.products)

    @cached_property
    def payments_by_order(self) -> DataFrame:
        return intermediate.payments_by_order(self.payments)

    def _lifecycle(self, latest: DataFrame, also: tuple[str, ...] = (), by_order: bool = False, placed: DataFrame | None = None) -> DataFrame:
        f = self.feeds
        # the newest event of the feed is that of its versions: copies repeat event times
        return intermediate.orders_lifecycle(latest, self.clock, self.customers_scd2, f.ref_states, f.ref_hubs, f.sale_calendar, f.payments, self.settings, also, by_order, placed)

    @cached_property
    def lifecycle(self) -> DataFrame:
        return self._lifecycle(self.latest)

    @cached_property
    def fct_orders(self) -> DataFrame:
        """Of a stored life cycle, if there is one. Otherwise all that goes by order is joined while orders are still dealt by
        order, so that they move to their customers once and not back."""
        if self.by_models or "lifecycle" in self.__dict__:
            return core.fct_orders(self.lifecycle, self.items_by_order, self.payments_by_order)
        items, payments = self.items_by_order, self.payments_by_order
        also = tuple(c for c in (*items.columns, *payments.columns) if c != "order_id")
        joined = self.latest.join(items, "order_id", "left").join(payments, "order_id", "left")
        return core.in_contract(self._lifecycle(joined, also))

    @cached_property
    def fct_by_order(self) -> DataFrame:
        """fct_orders dealt by order, for what is joined with it by order later and would have to move the whole of it."""
        return core.fct_orders(self._lifecycle(self.latest, by_order=True), self.items_by_order, self.payments_by_order)

    def fct_by_steps(self, folder: str) -> DataFrame:
        """fct_orders, made of steps that are stored in a folder, in buckets by order: the join of them moves no row, and disks hold
        what one step moves at a time. Lines of orders that aren't there go no further than to where their orders would be, and
        orders go to their customers and back with the columns alone that this takes."""
        f = self.feeds
        latest = dealt(self.latest.select(*intermediate.OF_LATEST), "order_id", f"{folder}/latest")
        lines = f.order_items.join(latest.select("order_id"), "order_id", "left_semi")
        items = dealt(intermediate.items_by_order(staging.order_items(lines), self.products), "order_id", f"{folder}/items")
        payments = dealt(self.payments_by_order, "order_id", f"{folder}/payments")
        placed = dealt(intermediate.customers_at_purchase(latest, self.customers_scd2), "order_id", f"{folder}/placed")
        return core.fct_orders(self._lifecycle(latest, placed=placed), items, payments)

    def dealt_fact(self) -> DataFrame:
        """fct_by_steps, stored in buckets by order itself; the steps are removed."""
        with scratch(self.feeds.orders.sparkSession) as folder:
            return dealt(self.fct_by_steps(folder), "order_id", move=False)  # the contract's guards hide how orders lie

    @cached_property
    def stored_fact(self) -> DataFrame:
        """The fact, computed once for what reads it more than once."""
        return materialised(self.fct_orders)

    def fact_for(self, *names: str) -> DataFrame:
        """The fact, computed once for these marts, which read it more than once: the stored one, if there is one, else what they
        take from it."""
        if self.by_models or "stored_fact" in self.__dict__:
            return self.stored_fact
        taken = {c for m in names for c in marts.FACT_COLUMNS[m]} | set(marts.GUARDED)
        fact = self.fct_orders
        return materialised(fact.select([c for c in fact.columns if c in taken]))

    @cached_property
    def dim_geography(self) -> DataFrame:
        return core.dim_geography(self.feeds.ref_states)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return core.dim_customers(self.customers_scd2, self.dim_geography)

    @cached_property
    def dim_hubs(self) -> DataFrame:
        return core.dim_hubs(self.feeds.ref_hubs, self.sellers)

    @cached_property
    def dim_products(self) -> DataFrame:
        return core.dim_products(self.products, self.sellers)

    @cached_property
    def dim_date(self) -> DataFrame:
        return core.dim_date(self.feeds.orders, self.feeds.sale_calendar)

    @cached_property
    def fct_order_items(self) -> DataFrame:
        return core.fct_order_items(self.order_items, self.fct_orders, self.dim_products)

    @cached_property
    def fct_order_status_history(self) -> DataFrame:
        return core.fct_order_status_history(self.status_history, self.fct_orders)

    @cached_property
    def data_quality_daily(self) -> DataFrame:
        return marts.data_quality_daily(self.feeds.orders, self.orders_cdc, self.latest)

    @cached_property
    def fulfillment_daily(self) -> DataFrame:
        return marts.fulfillment_daily(self.fact_for("fulfillment_daily"))

    @cached_property
    def state_scorecard(self) -> DataFrame:
        return marts.state_scorecard(self.fact_for("state_scorecard"))

    @cached_property
    def courier_performance(self) -> DataFrame:
        return marts.courier_performance(self.fact_for("courier_performance"))

    @cached_property
    def stage_bottlenecks(self) -> DataFrame:
        return marts.stage_bottlenecks(self.fct_orders)

    @cached_property
    def sale_event_impact(self) -> DataFrame:
        return marts.sale_event_impact(self.fct_orders, self.feeds.sale_calendar)

    @cached_property
    def order_funnel(self) -> DataFrame:
        return marts.order_funnel(self.fct_orders)


def by_order(df: DataFrame) -> DataFrame:
    return dealt(df, "order_id")


def changes(
    feeds: Feeds, target: DataFrame, settings: intermediate.Settings = intermediate.Settings(), keep: Callable[[DataFrame], DataFrame] = by_order
) -> tuple[Warehouse, DataFrame]:
    """(models, keys): the models over the orders that are affected by what was loaded since target, and these orders, as `keep`
    stores them.

    Feeds are cut down to the affected orders first, so that an increment costs what it touches.
    """
    keys = keep(affected(feeds, target))
    return Warehouse(restricted(feeds, keys), settings, clock=feeds.orders), keys


def clustered_changes(
    store: FeedStore, feeds: Feeds, target: DataFrame, settings: intermediate.Settings = intermediate.Settings(), keep: Callable[[DataFrame], DataFrame] = by_order
) -> tuple[Warehouse, DataFrame]:
    """As `changes`, of feeds that are stored by the month of their orders: only folders with newer loads are searched for what
    was loaded since, and only the months of the affected orders are read."""
    keys = keep(store.affected(target))
    return Warehouse(store.restricted(feeds, keys), settings, clock=store.clock()), keys.select("order_id")


def increment(feeds: Feeds, target: DataFrame, settings: intermediate.Settings = intermediate.Settings()) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): the fact's rows of the orders that are affected by what was loaded since target, and these orders."""
    models, keys = changes(feeds, target, settings, materialised)
    return models.fct_orders, keys


def clustered_increment(store: FeedStore, feeds: Feeds, target: DataFrame, settings: intermediate.Settings = intermediate.Settings()) -> tuple[DataFrame, DataFrame]:
    """As `increment`, of feeds that are stored by the month of their orders."""
    models, keys = clustered_changes(store, feeds, target, settings, materialised)
    return models.fct_orders, keys
