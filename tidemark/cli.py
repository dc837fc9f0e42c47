"""Commands: generate, load, transform, run, advance, watch, status, freshness, results and vacuum."""

from __future__ import annotations

import argparse
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.ask import Desk
from tidemark.plans.build import Builder
from tidemark.schemas import RAW
from tidemark.session import session
from tidemark.sources.commits import CommitLog
from tidemark.sources.freshness import freshness
from tidemark.sources.loader import Loader, last_run, run_results
from tidemark.sources.schedule import Runs, Sensor
from tidemark.sources.seed_files import export_seeds, load_seeds
from tidemark.sources.simulate import Plan, Simulator
from tidemark.sources.tables import Feeds


class Project:
    """Landing folder, raw feeds, seeds and the built tables under one root."""

    def __init__(self, spark: SparkSession, root: str, plan: Plan = Plan()):
        self.spark, self.root, self.plan = spark, root.rstrip("/"), plan
        self.simulator = Simulator(spark, plan)
        self.loader = Loader(spark, f"{self.root}/landing", f"{self.root}/raw", marked=True)
        self.builder = Builder(spark, self.root)

    def generate(self, until: date | None = None) -> None:
        export_seeds(self.simulator, f"{self.root}/seeds")
        self.simulator.write(f"{self.root}/landing", until)

    def load(self):
        return self.loader.run()

    def feeds(self) -> Feeds:
        t = self.loader.table
        return Feeds(t("orders"), t("customers"), t("order_items"), t("payments"), t("products"), t("sellers"), **load_seeds(self.spark, f"{self.root}/seeds"))

    def transform(self, full_refresh: bool = False, select: str | None = None) -> DataFrame:
        """Builds and tests all models, or those selected; the fact takes what was loaded since, unless all of it is to be built
        anew."""
        return self.builder.run(self.feeds(), full_refresh, command="transform", select=select).fct_orders

    def advance(self, days: int) -> DataFrame:
        """Releases the days after the newest landed one, up to the plan's end, loads and builds."""
        landed = self.loader.discover("orders").select(F.max(F.regexp_extract("file_path", r"dt=(\d{4}-\d{2}-\d{2})", 1)).alias("d")).first()["d"]
        newest = date.fromisoformat(landed) if landed else self.plan.start - timedelta(1)
        self.generate(min(newest + timedelta(days), self.plan.end))
        self.load()
        return self.transform()

    def freshness(self) -> DataFrame:
        """Ages of the feeds by the clock of the session: warn from one day, error from three."""
        now = F.current_timestamp()
        return freshness({name: self.loader.table(name) for name in RAW}, now)

    def take_results(self, path: str, command: str = "imported") -> int:
        """Adds the run results of another tool's document (JSON) to those of the builds; how many."""
        text = self.spark.read.text(path, wholetext=True).first()[0]
        rows = run_results(self.spark, text, command).withColumn("generated_at", F.col("generated_at").cast("timestamp_ntz"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/ops/run_results")
        return rows.count()

    def watch(self, seconds: float = 60.0, times: int | None = None) -> int:
        """Loads and builds whenever files have landed; of several that watch one project, one does it."""
        sensor = Sensor(self.loader, Runs(CommitLog(self.spark, f"{self.root}/ops/runs")), running=True)
        return sensor.watch(lambda: (self.load(), self.transform()), seconds, times)

    def desk(self) -> Desk:
        return Desk(self.builder)

    def status(self) -> dict[str, DataFrame]:
        """What was loaded, the tables with their rows, and how the last build ended."""
        manifest = self.loader.manifest()
        out = {"loads": manifest.groupBy("entity").agg(F.count("*").alias("files"), F.sum("rows_loaded").alias("rows"), F.max("loaded_at").alias("last_load"))}
        out["tables"] = self.builder.catalogue()
        results = self.builder.results()
        if results is not None:
            out["last run"] = last_run(results)
        return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("command", choices=["generate", "load", "transform", "run", "advance", "status", "freshness", "results", "watch", "vacuum"])
    parser.add_argument("--root", default="data")
    parser.add_argument("--days", type=int, default=1)
    parser.add_argument("--until", type=date.fromisoformat)
    parser.add_argument("--full-refresh", action="store_true")
    parser.add_argument("--select", help="models or layers to build, + before or behind for what they need or what needs them")
    parser.add_argument("--file", help="a document of run results")
    parser.add_argument("--times", type=int, help="how often to look, for ever if not given")
    given = parser.parse_args(args)
    project = Project(session(), given.root)
    if given.command in ("generate", "run"):
        project.generate(given.until)
    if given.command in ("load", "run"):
        print(project.load().to_json())
    if given.command in ("transform", "run"):
        built = project.transform(given.full_refresh, given.select)
        print(f"{built.count()} orders" if given.select is None else f"built {given.select}")
    if given.command == "advance":
        print(f"{project.advance(given.days).count()} orders")
    if given.command == "freshness":
        ages = project.freshness()
        ages.show(truncate=False)
        if not ages.filter("status = 'error'").isEmpty():
            raise SystemExit(1)
    if given.command == "results":
        print(f"{project.take_results(given.file)} results")
    if given.command == "watch":
        print(f"{project.watch(times=given.times)} runs")
    if given.command == "vacuum":
        print(f"{project.builder.vacuum()} folders removed")
    if given.command == "status":
        for title, table in project.status().items():
            print(title)
            table.show(100, truncate=False)


if __name__ == "__main__":
    main()
