"""Manifest-tracked, idempotent loading of daily CSV extracts."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import MANIFEST, RAW, SNAPSHOTS
from tidemark.session import materialised
from tidemark.sources.commits import CommitLog, State, Store, Table

TIMESTAMPS = "yyyy-MM-dd HH:mm:ss"


@dataclass
class LoadReport:
    load_id: str
    files: dict[str, int] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    changed: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def is_missing(e: Exception) -> bool:
    """Whether Spark says that there is nothing at a path."""
    return isinstance(e, AnalysisException) and e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class Loader:
    """Loads landing/<entity>/dt=<day>/*.csv into raw/<entity>/ and records each file in a manifest.

    Rows and manifest entries of a load are written first, to folders of their own; one commit of raw/_log makes both current.
    A load that broke off is never seen and runs again as a whole. Of two loads of an entity at once the second finds that
    the first has committed, and plans anew: files that are in the manifest by now are skipped, so each is loaded once. If a
    file has changed since it was loaded, it is reported and not loaded again. Snapshots are written beside the current one
    and swapped by a commit. All paths go through Spark, so any store that Spark reads will do.
    """

    #: Files that are read together. A first load of very many goes in steps, by days.
    FILES = 10_000

    def __init__(self, spark: SparkSession, landing: str, raw: str, marked: bool = False):
        """marked: only days with the mark that `write_daily` leaves when a day is complete are read."""
        self.spark, self.landing, self.raw, self.marked = spark, landing.rstrip("/"), raw.rstrip("/"), marked
        self.log = CommitLog(spark, f"{self.raw}/_log")

    def discover(self, entity: str) -> DataFrame:
        """(entity, file_path relative to the landing folder, file_bytes, file_mtime); contents aren't read."""
        files = None
        days = published_days(self.spark, f"{self.landing}/{entity}") if self.marked else ["*"]
        try:
            if days:
                files = self.spark.read.format("binaryFile").load([f"{self.landing}/{entity}/dt={d}/*.csv" for d in days])
        except Exception as e:
            if not is_missing(e):
                raise
        if files is None:
            files = self.spark.createDataFrame([], "path string, length long, modificationTime timestamp")
        return files.select(
            F.lit(entity).alias("entity"),
            F.regexp_extract("path", rf".*({entity}/dt=[^/]+/[^/]+)$", 1).alias("file_path"),
            F.col("length").alias("file_bytes"),
            F.col("modificationTime").cast("timestamp_ntz").alias("file_mtime"),
        )

    def _loads(self, entity: str, state: State | None = None) -> list[dict[str, str]]:
        return [json.loads(v) for _, v in sorted((state or self.log.state()).under(f"{entity}/").items())]

    def manifest(self, state: State | None = None) -> DataFrame:
        state = state or self.log.state()
        folders = [f"{self.raw}/_manifest/{load['files']}" for entity in RAW for load in self._loads(entity, state)]
        return self.spark.read.schema(MANIFEST).parquet(*folders) if folders else self.spark.createDataFrame([], MANIFEST)

    def states(self, entity: str, state: State | None = None) -> DataFrame:
        """discover, with state: new, changed (another size or time than when it was loaded) or loaded."""
        seen = self.manifest(state).select("entity", "file_path", F.col("file_bytes").alias("_bytes"), F.col("file_mtime").alias("_mtime"))
        same = (F.col("file_bytes") == F.col("_bytes")) & (F.col("file_mtime") == F.col("_mtime"))
        now = F.when(F.col("_bytes").isNull(), "new").when(same, "loaded").otherwise("changed")
        return self.discover(entity).join(seen, ["entity", "file_path"], "left").withColumn("state", now).drop("_bytes", "_mtime")

    def _read(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        """A line that doesn't fit the schema ends the load, before anything of it is published."""
        reader = self.spark.read.schema(schema).option("header", True).option("timestampNTZFormat", TIMESTAMPS)
        return reader.option("mode", "FAILFAST").csv(paths)

    def _steps(self, files: DataFrame) -> list[list[str]]:
        """Days of new files, dealt so that a step has about FILES files."""
        steps, size = [[]], 0
        for r in sorted(files.groupBy(_day(F.col("file_path")).alias("day")).agg(F.count("*").alias("n")).collect()):
            if steps[-1] and size + r["n"] > self.FILES:
                steps.append([])
                size = 0
            steps[-1].append(r["day"])
            size += r["n"]
        return steps if steps[0] else []

    def write_rows(self, entity: str, load_id: str, files: DataFrame, rows: DataFrame) -> str:
        """Writes rows (with their `_source_file`) and the manifest's entries of files, under a new name: it says what to commit."""
        now = F.current_timestamp().cast("timestamp_ntz")
        name = f"data={uuid.uuid4().hex}"
        target = f"{self.raw}/{entity}/{name}"
        rows.withColumns({"_loaded_at": now, "_load_id": F.lit(load_id)}).write.parquet(target)
        counts = self.spark.read.parquet(target).groupBy(F.col("_source_file").alias("file_path")).agg(F.count("*").alias("n"))
        entry = files.join(counts, "file_path", "left").select(
            "entity", "file_path", "file_bytes", "file_mtime", F.coalesce("n", F.lit(0)).cast("long").alias("rows_loaded"),
            F.lit(load_id).alias("load_id"), now.alias("loaded_at"),
        )
        entry.coalesce(1).write.parquet(f"{self.raw}/_manifest/{name}")
        return json.dumps({"rows": name, "files": name, "load_id": load_id})

    def commit_rows(self, entity: str, seen: State, written: list[str]) -> None:
        """Makes what was written current, unless another load of the entity has done so since `seen`."""
        put = {f"{entity}/{json.loads(w)['rows']}": w for w in written}
        self.log.commit(seen, put, depends=lambda k: k.startswith(f"{entity}/"))

    def _load(self, entity: str, load_id: str, report: LoadReport) -> None:
        seen = self.log.state()
        states = materialised(self.states(entity, seen))
        found = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        changed = sorted(r["file_path"] for r in states.filter("state = 'changed'").select("file_path").collect())
        fresh = states.filter("state = 'new'").drop("state")
        written = []
        for days in self._steps(fresh):
            files = fresh.filter(_day(F.col("file_path")).isin(days))
            paths = [f"{self.landing}/{r['file_path']}" for r in files.select("file_path").collect()]
            rows = self._read(RAW[entity], paths)
            source = F.regexp_extract(F.col("_metadata.file_path"), rf".*({entity}/dt=[^/]+/[^/]+)$", 1)
            written.append(self.write_rows(entity, load_id, files, rows.withColumn("_source_file", source)))
        if written:
            self.commit_rows(entity, seen, written)
        report.skipped[entity] = sum(n for state, n in found.items() if state != "new")
        report.files[entity] = found.get("new", 0)
        report.changed += changed
        loaded = self.manifest().filter((F.col("load_id") == load_id) & (F.col("entity") == entity))
        report.rows[entity] = (loaded.agg(F.sum("rows_loaded")).first()[0] or 0) if written else 0

    def _snapshots(self, entity: str) -> Table:
        return Table(self.log, self.spark, f"{self.raw}/{entity}", entity)

    def _snapshot(self, entity: str, report: LoadReport) -> None:
        try:
            rows = self._read(SNAPSHOTS[entity], [f"{self.landing}/{entity}.csv"])
        except Exception as e:
            if not is_missing(e):
                raise
            return
        now = F.current_timestamp().cast("timestamp_ntz")
        report.rows[entity] = self.log.retried(lambda: self._snapshots(entity).publish(rows.withColumn("_loaded_at", now))).count()

    def run(self, load_id: str | None = None) -> LoadReport:
        report = LoadReport(load_id or uuid.uuid4().hex)
        for entity in RAW:
            self.log.retried(lambda entity=entity: self._load(entity, report.load_id, report))
        for entity in SNAPSHOTS:
            self._snapshot(entity, report)
        return report

    def table(self, entity: str) -> DataFrame:
        """All rows of published loads, with their lineage columns."""
        if entity in SNAPSHOTS:
            found = self._snapshots(entity).read()
            return self.spark.createDataFrame([], T.StructType([*SNAPSHOTS[entity].fields, T.StructField("_loaded_at", T.TimestampNTZType())])) if found is None else found
        lineage = T.StructType([*RAW[entity].fields, *[T.StructField(n, k) for n, k in (("_source_file", T.StringType()), ("_loaded_at", T.TimestampNTZType()), ("_load_id", T.StringType()))]])
        folders = [f"{self.raw}/{entity}/{load['rows']}" for load in self._loads(entity)]
        return self.spark.read.schema(lineage).parquet(*folders) if folders else self.spark.createDataFrame([], lineage)


def _day(path: Column) -> Column:
    return F.regexp_extract(path, r"dt=([^/]+)/", 1)


#: The mark of a day that is complete. Spark's readers skip names that begin so.
MARK = "_PUBLISHED"


def published_days(spark: SparkSession, path: str) -> list[str]:
    """The days of a daily feed that are complete."""
    store = Store(spark, path)
    days = [n.removeprefix("dt=") for n in store.names(path) if n.startswith("dt=")]
    return sorted(d for d in days if store.exists(f"{path}/dt={d}/{MARK}"))


def write_daily(df: DataFrame, day: str, landing: str, entity: str, order: tuple[str, ...] = ()) -> list[str]:
    """Publishes a feed as one folder per day and says which days are new; complete days are left alone. The rows of a file
    stand in `order`.

    All days are written aside, then moved into place one by one, and each is marked when it is there as a whole. A writer
    that dies leaves days that are complete and days that aren't; the next one makes the latter anew.
    """
    path, spark = f"{landing.rstrip('/')}/{entity}", df.sparkSession
    store, aside = Store(spark, path), f"{path}/.aside-{uuid.uuid4().hex}"
    known = published_days(spark, path)
    days = df.withColumn("dt", F.col(day).cast("date")).filter("dt is not null")
    if known:
        days = days.join(spark.createDataFrame([(d,) for d in known], "d string"), F.col("dt") == F.col("d").cast("date"), "left_anti")
    try:
        # dealt by day, but a day with very many rows goes to several tasks and files
        dealt = days.hint("rebalance", "dt").sortWithinPartitions("dt", *order)
        dealt.write.partitionBy("dt").option("header", True).option("timestampNTZFormat", TIMESTAMPS).csv(aside)
        fresh = sorted(n for n in store.names(aside) if n.startswith("dt="))
        for name in fresh:
            if store.exists(f"{path}/{name}"):
                if store.exists(f"{path}/{name}/{MARK}"):
                    continue  # another writer was faster
                store.delete(f"{path}/{name}")
            store.move(f"{aside}/{name}", f"{path}/{name}")
            store.write(f"{path}/{name}/{MARK}", "")
        return [n.removeprefix("dt=") for n in fresh]
    finally:
        store.delete(aside)


RUN_RESULTS = (
    "invocation_id string, command string, generated_at timestamp, unique_id string, resource_type string, status string, "
    "execution_s double, rows_affected long, failures long, message string"
)


def run_results(spark: SparkSession, document: str, command: str) -> DataFrame:
    """Rows of a run-results document (JSON): one per executed node."""
    content = json.loads(document)
    meta = content.get("metadata", {})
    rows = []
    for r in content.get("results", []):
        unique_id = r.get("unique_id", "")
        affected = (r.get("adapter_response") or {}).get("rows_affected")
        rows.append(
            (
                meta.get("invocation_id"), command, meta.get("generated_at"), unique_id, unique_id.split(".")[0], r.get("status"),
                float(r.get("execution_time") or 0.0), affected if affected is None or affected >= 0 else None, r.get("failures"), r.get("message"),
            )
        )
    text = RUN_RESULTS.replace("generated_at timestamp", "generated_at string")
    return spark.createDataFrame(rows, text).withColumn("generated_at", F.to_timestamp("generated_at"))


def last_run(results: DataFrame) -> DataFrame:
    """Status counts of the newest invocation."""
    newest = results.orderBy(F.desc("generated_at")).limit(1).select("invocation_id")
    return results.join(F.broadcast(newest), "invocation_id", "left_semi").groupBy("status").agg(F.count("*").alias("n"), F.sum("execution_s").alias("seconds"))
