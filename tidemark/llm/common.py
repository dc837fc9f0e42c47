"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows on its way to or from Python. Texts are long, so Spark's own bound is too large for
#: executors whose memory several Python workers share.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and all of Spark is one process is a folder made here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def lasting(df: DataFrame) -> DataFrame:
    """df, written to a checkpoint and read from there. spark.cleaner.referenceTracking.cleanCheckpoints lets Spark remove it
    once nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, what is checkpointed goes to tables of a folder that is removed in the end, so results must be `lasting`.

    Checkpoints carry Spark's estimate of their size on, and joins multiply it: over many rounds the estimates alone fill the
    driver's memory. The size of a written table is that of its files.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, *parts: str) -> DataFrame:
    """df, computed and read from the shared folder, so that its lineage ends: a table within `scratch` (with a folder for each
    value of `parts`, so that a filter on them reads no others), else a checkpoint."""
    folder = _scratch.get()
    if folder is None:
        return lasting(df)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fields(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """(row, *more): the rows of df as one struct column, so that no name of theirs clashes with those of `more`."""
    return df.select(F.struct(*fields(df)).alias("row"), *[c.alias(k) for k, c in more.items()])


def thinned(text: Column, most: int, part: str) -> Column:
    """text if it has at most `most` code points; else those of its parts (matches of the pattern `part`) that a hash
    of their place chooses, about `most` code points together, from all of the text."""
    # the one-element array binds the length, which is then counted once and not for each part
    kept = F.transform(
        F.array(F.char_length(text)),
        lambda n: F.array_join(F.filter(F.regexp_extract_all(text, F.lit(part), F.lit(0)), lambda x, i: F.pmod(F.xxhash64(i), n) < most), ""),
    )
    return F.when(F.char_length(text) <= most, text).otherwise(F.get(kept, F.lit(0)))


def release() -> None:
    """Gives memory that Python has freed back to the system (where that is glibc's to do)."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's text leaves `fold` modulo `folds`; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


class Memo(dict):
    """A bounded cache of fn(key): two generations, of which the older is dropped when the newer is full.

    Lookups go through dict.__getitem__ at C speed; call `trim` now and then (after each text, say).
    """

    def __init__(self, fn, size: int = 100_000):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
