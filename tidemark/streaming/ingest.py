"""Feeds as streams of files: into the manifest-tracked raw tables, or deduplicated on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schemas import RAW
from tidemark.sources.loader import TIMESTAMPS, Loader


def order_stream(spark: SparkSession, landing: str) -> DataFrame:
    """New order files as they land, with their path."""
    return file_stream(spark, landing, "orders").withColumn("_source_file", F.col("_metadata.file_path"))


def file_stream(spark: SparkSession, landing: str, entity: str) -> DataFrame:
    reader = spark.readStream.schema(RAW[entity]).option("header", True).option("timestampNTZFormat", TIMESTAMPS).option("mode", "FAILFAST")
    return reader.csv(f"{landing}/{entity}/dt=*")


def ingest(rows: DataFrame, target: str, checkpoint: str, lateness: str = "4 days") -> StreamingQuery:
    """Appends what has landed so far, then ends; each file is read once.

    Copies of a version that arrive within `lateness` of each other are dropped on the way, with state bounded by that
    time; no first copy is ever dropped for being late by event time, because the watermark runs on load time. Copies
    further apart are left to the batch deduplication.
    """
    stamped = rows.withColumn("_loaded_at", F.current_timestamp())
    kept = stamped.withWatermark("_loaded_at", lateness).dropDuplicatesWithinWatermark(["order_id", "order_status", "updated_at"])
    writer = kept.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(target)


def load_stream(loader: Loader, entity: str, checkpoint: str, name: str = "stream", files_a_batch: int = 1000) -> StreamingQuery:
    """Loads what has landed so far as `loader` does, in small batches, then ends.

    A batch is a commit under its own number, with its files in the manifest; one that is replayed after a crash is found there
    and written no second time, and files that a batch load has taken meanwhile are left out. Files that change later are
    told by `loader.states`, however they were loaded. A file without rows leaves no entry.
    """
    spark, log = loader.spark, loader.log
    source = file_stream(spark, loader.landing, entity)
    meta = source.select(
        *RAW[entity].names,
        F.regexp_extract("_metadata.file_path", rf".*({entity}/dt=[^/]+/[^/]+)$", 1).alias("_source_file"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_mtime"),
    )

    def write(batch: DataFrame, number: int) -> None:
        key, load_id = f"{entity}/{name}-{number:09d}", f"{name}-{number}"

        def attempt() -> None:
            seen = log.state()
            if key in seen.values:
                return
            known = loader.manifest(seen).filter(F.col("entity") == entity).select(F.col("file_path").alias("_source_file"))
            fresh = batch.join(known, "_source_file", "left_anti")
            files = fresh.select(F.lit(entity).alias("entity"), F.col("_source_file").alias("file_path"), "file_bytes", "file_mtime").distinct()
            written = loader.write_rows(entity, load_id, files, fresh.select(*RAW[entity].names, "_source_file"))
            log.commit(seen, {key: written}, depends=lambda k: k.startswith(f"{entity}/"))

        batch.persist()  # read for its files and for its rows
        try:
            log.retried(attempt)
        finally:
            batch.unpersist()

    writer = meta.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
