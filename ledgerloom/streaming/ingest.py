"""Streams beside the batch path: incremental ingest, windowed counts with late rows, and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.corpus import load, read_corpus


def new_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """The files that come in under ``path``, by relative name, ``per_batch`` at a time; their contents are not read."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.substring_index(F.col("path"), path.rstrip("/") + "/", -1).alias("source_file"))


def ingest(spark: SparkSession, path: str, store: str, checkpoint: str, per_batch: int = 1000, **trigger):
    """Load files as they come in under ``path`` into ``store``, no record twice.

    Each batch of files goes through the same reader as a batch load, so a record has the same hash and the same id
    whichever way it comes, in every format.
    """

    def one(batch: DataFrame, _: int) -> None:
        names = [r[0] for r in batch.collect()]  # at most ``per_batch``
        if names:
            load(read_corpus(spark, path, files=names), store)

    stream = new_files(spark, path, per_batch)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are dropped (on a batch nothing is late)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide or width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, key: str, quiet: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per key: runs of events with no longer pause than ``quiet``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, quiet), key).agg(F.count("*").alias("n"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs of one key whose times lie at most ``within`` apart; both sides carry watermarks, so state stays bounded."""
    l, r = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnRenamed(key, "_key")
    near = F.expr(f"{right_time} BETWEEN {left_time} - INTERVAL {within} AND {left_time} + INTERVAL {within}")
    return l.join(r, (F.col(key) == F.col("_key")) & near).drop("_key")
