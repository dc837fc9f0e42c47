"""Incremental maintenance by load time: delete and insert by key, published as versions of partitions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commits import CommitLog, Staged, Table
from tidemark.sources.tables import Feeds

KEY = "order_id"


def affected(feeds: Feeds, target: DataFrame, loaded: str = "source_last_loaded_at") -> DataFrame:
    """Orders of which anything was loaded after all that target has seen, and those that target has as open.

    Event times don't matter: a row may be late by any time. Open orders are affected as passing time alone can make them
    overdue. The watermark is one value, a literal for the scans of the feeds, so that they skip what is older.
    """
    seen = target.agg(F.max(loaded)).first()[0]
    rows = feeds.orders.select(KEY, "_loaded_at").unionByName(feeds.payments.select(KEY, "_loaded_at"))
    if seen is not None:
        rows = rows.filter(F.col("_loaded_at") > F.lit(seen).cast("timestamp_ntz"))
    return rows.select(KEY).unionByName(target.filter("is_open").select(KEY)).distinct()


def restricted(feeds: Feeds, keys: DataFrame) -> Feeds:
    """The feeds' rows of these orders and of their customers, before anything is sorted or joined."""

    def only(df: DataFrame) -> DataFrame:
        return df.join(keys, KEY, "left_semi")

    orders = only(feeds.orders)
    customers = feeds.customers.join(orders.select("customer_id").distinct(), "customer_id", "left_semi")
    return replace(feeds, orders=orders, customers=customers, order_items=only(feeds.order_items), payments=only(feeds.payments))


def delete_insert(target: DataFrame, rebuilt: DataFrame, keys: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """target with the rows of rebuilt in place of its own rows of `keys` (those of rebuilt, if not given)."""
    gone = rebuilt.select(key) if keys is None else keys
    return target.join(gone, key, "left_anti").select(target.columns).unionByName(rebuilt)


class Versioned(Table):
    """A table of which an increment writes anew only the partitions that it touches."""

    def __init__(self, spark: SparkSession, path: str, part: str = "'all'", log: CommitLog | None = None, name: str = "table"):
        super().__init__(log or CommitLog(spark, f"{path.rstrip('/')}/_log"), spark, path, name, part)

    def stage_replace(self, rebuilt: DataFrame, keys: DataFrame, key: str = KEY) -> Staged:
        """rebuilt in place of the rows of `keys`. Both are read more than once, so they should be stored."""
        seen = self.log.state()
        now = Staged(seen, {})
        old = self.read(staged=now)
        parts = rebuilt.select(self.part.alias("p"))
        if old is not None:
            parts = parts.unionByName(old.join(keys, key, "left_semi").select(self.part.alias("p")))
        touched = [r["p"] for r in parts.distinct().collect()]
        if not touched:
            return Staged(seen, {}, whole=False)
        before = self.read(touched, now)
        return self.stage_parts(rebuilt if before is None else delete_insert(before, rebuilt, keys, key), touched, seen)

    def replace(self, rebuilt: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
        """Publishes rebuilt in place of the rows of `keys`; planned anew if another writer has changed the same partitions."""
        self.log.retried(lambda: self.commit(self.stage_replace(rebuilt, keys, key)))
        return self.read()
