"""Raw feeds clustered by the month of their orders, with a summary of each folder, so that an increment reads few of them."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import dealt, scratch, shuffles_removed
from tidemark.sources.commits import CommitLog, State
from tidemark.sources.tables import Feeds

KEY, HOME, NOWHERE = "order_id", "home", "none"
FED = ("orders", "order_items", "payments")


def month(day: str) -> F.Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NOWHERE))


class FeedStore:
    """The feeds by order, in a folder for each month of purchase (its home) and load.

    The log has the newest load and event time of each folder. What was loaded since a moment is looked for in the folders with
    newer loads; all that belongs to some orders in the folders of their homes. Both lists come from the log, so the files of
    other folders aren't even opened. An order's home is that of its first version, wherever later ones stand; rows whose
    order isn't known go to a home of their own, which is read always.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_log")

    def _folders(self, feed: str, state: State, homes: set[str] | None = None, since: datetime | None = None) -> list[str]:
        out = []
        for value in state.under(f"{feed}/").values():
            one = json.loads(value)
            fresh = since is None or one["loaded"] is None or datetime.fromisoformat(one["loaded"]) > since
            if fresh and (homes is None or one["home"] in homes):
                out.append(f"{self.root}/{one['folder']}")
        return sorted(out)

    def read(self, feed: str, homes: set[str] | None = None, since: datetime | None = None, state: State | None = None) -> DataFrame | None:
        """The rows of a feed with their home; of some homes, or of folders that were loaded after a moment, alone."""
        paths = self._folders(feed, state or self.log.state(), homes, since)
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/{feed}").parquet(*paths)
        return rows.withColumn(HOME, F.col(HOME).cast("string")).drop("load")

    def _homes(self, fresh: DataFrame, state: State) -> DataFrame:
        """(order_id, home) of all orders: that which they have, else that of their first version among fresh rows."""
        first = fresh.groupBy(KEY).agg(month(F.min("purchase_at")).alias(HOME))
        known = self.read("homes", state=state)
        if known is None:
            return first
        return known.select(KEY, HOME).unionByName(first.join(known.select(KEY), KEY, "left_anti"))

    def add(self, feeds: Feeds) -> None:
        """Adds rows of the three feeds (new ones: what is there already is not looked for) in one commit."""
        with scratch(self.spark) as folder:
            self._add(feeds, self.log.state(), folder)

    def _add(self, feeds: Feeds, state: State, folder: str) -> None:
        load, homes = uuid.uuid4().hex, dealt(self._homes(feeds.orders, state), KEY, f"{folder}/homes")
        known = self.read("homes", state=state)
        put = {}
        parts = {"homes": homes if known is None else homes.join(known.select(KEY), KEY, "left_anti")}
        parts |= {f: getattr(feeds, f).join(homes, KEY, "left").withColumn(HOME, F.coalesce(HOME, F.lit(NOWHERE))) for f in FED}
        for feed, rows in parts.items():
            # dealt by home; a month with very many rows goes to several tasks and files
            target = f"{self.root}/{feed}"
            with shuffles_removed(self.spark):
                rows.withColumn("load", F.lit(load)).hint("rebalance", HOME).write.partitionBy(HOME, "load").mode("append").parquet(target)
            written = [f"{target}/{n}/load={load}" for n in self.log.store.names(target) if n.startswith(f"{HOME}=") and self.log.store.exists(f"{target}/{n}/load={load}")]
            if not written:
                continue
            newest = [F.max("_loaded_at").alias("loaded") if feed != "homes" else F.lit(None).alias("loaded"), F.max("updated_at").alias("updated") if feed == "orders" else F.lit(None).alias("updated")]
            there = self.spark.read.option("basePath", target).parquet(*written).withColumn(HOME, F.col(HOME).cast("string"))
            for r in there.groupBy(HOME).agg(*newest).collect():
                text = lambda x: x.isoformat() if x else None
                put[f"{feed}/{r[HOME]}/{load}"] = json.dumps({"folder": f"{feed}/{HOME}={r[HOME]}/load={load}", "home": r[HOME], "loaded": text(r["loaded"]), "updated": text(r["updated"])})
        self.log.commit(state, put, depends=lambda k: True)

    def affected(self, target: DataFrame, loaded: str = "source_last_loaded_at") -> DataFrame:
        """(order_id, home) of orders of which anything was loaded after all that target has seen, and of its open ones."""
        seen = target.agg(F.max(loaded)).first()[0]
        open_ = target.filter("is_open").select(KEY, month("order_date").alias(HOME))
        for feed in ("orders", "payments"):
            rows = self.read(feed, since=seen)
            if rows is not None:
                rows = rows if seen is None else rows.filter(F.col("_loaded_at") > F.lit(seen).cast("timestamp_ntz"))
                open_ = open_.unionByName(rows.select(KEY, HOME))
        return open_.groupBy(KEY).agg(F.min(HOME).alias(HOME))

    def restricted(self, feeds: Feeds, keys: DataFrame) -> Feeds:
        """feeds, with the rows of these orders (order_id, home), read from the folders of their homes, and their customers'."""
        homes = {r[HOME] for r in keys.select(HOME).distinct().collect()} | {NOWHERE}
        state, only = self.log.state(), {}
        for feed in FED:
            rows = self.read(feed, homes, state=state)
            only[feed] = getattr(feeds, feed).limit(0) if rows is None else rows.join(keys.select(KEY), KEY, "left_semi").select(getattr(feeds, feed).columns)
        customers = feeds.customers.join(only["orders"].select("customer_id").distinct(), "customer_id", "left_semi")
        return replace(feeds, customers=customers, **only)

    def clock(self) -> DataFrame:
        """The newest event time, of the log alone."""
        times = [json.loads(v)["updated"] for v in self.log.state().under("orders/").values()]
        newest = max((t for t in times if t), default=None)
        return self.spark.range(1).select(F.lit(newest).cast("timestamp_ntz").alias("updated_at"))
