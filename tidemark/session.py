"""Session settings the engine relies on."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Only where that is unset and all of Spark is one process is a folder made here.
    """
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, which is removed at the end."""
    folder = scratch_folder(spark)
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark removes what an execution has shuffled when it ends, and how many ask for that now.
REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_asked, _asking = {"n": 0, "before": "false"}, threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions within it remove what they have shuffled when they end, which else stays on the disks until the driver happens to
    collect its garbage. It suits results that are stored; a plan that is run again later shuffles again."""
    with _asking:
        if not _asked["n"]:
            _asked["before"] = spark.conf.get(REMOVAL, "false")
            spark.conf.set(REMOVAL, "true")
        _asked["n"] += 1
    try:
        yield
    finally:
        with _asking:
            _asked["n"] -= 1
            if not _asked["n"]:
                spark.conf.set(REMOVAL, _asked["before"])


def dealt(df: DataFrame, key: str, path: str | None = None, move: bool = True) -> DataFrame:
    """df, computed once and written in buckets by a key, to a folder (a new one in the shared folder, if not given): joins and
    groups by that key move no row of it. Without `move` rows are written where they are, for a df that is made of such tables
    in a way that hides it from Spark. The table is known by its folder alone, not by the catalog."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        (df.repartition(parts, key) if move else df).write.bucketBy(parts, key).option("path", path or scratch_folder(spark)).saveAsTable(name, format="parquet")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")  # the files stay


def written(df: DataFrame, path: str) -> DataFrame:
    """df, computed once and written as a table, of which readers take the columns that they need. Unlike a checkpoint's, its rows
    aren't known to be dealt by any key; under adaptive execution a checkpoint's aren't either. It is read but a few times, which
    dictionaries don't pay for."""
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unkept(name: str, kind: DataType | str) -> Column:
    """A column that isn't kept: it is there for plans that leave it out in the end, and raises if it is read."""
    return F.raise_error(F.lit(f"{name} is not kept")).cast(kind).alias(name)


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
