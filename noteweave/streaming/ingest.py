"""Incremental ingest of notes by Structured Streaming: each batch's changed notes update a manifest table.

The reference semantics are those of polling by hash; a stream of new files gives the same manifest. A manifest version
is written beside the one before and named by its batch, so a batch that runs again after a failure finds the version it
began from and writes the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteweave.operators.index import hashes
from noteweave.sources.vault import merge_rows

MANIFEST = "path string, hash string"


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The latest version of the manifest in ``folder``, or the latest of a batch before ``before``."""
    from pyspark.errors import AnalysisException

    try:
        versions = spark.read.schema(f"{MANIFEST}, batch long").option("basePath", folder).parquet(f"{folder}/batch=*")
    except AnalysisException:  # none yet
        return spark.createDataFrame([], MANIFEST)
    versions = versions if before is None else versions.filter(F.col("batch") < before)
    last = versions.agg(F.max("batch").alias("batch")).first().batch
    return spark.createDataFrame([], MANIFEST) if last is None else versions.filter(F.col("batch") == last).drop("batch")


def ingest(notes: DataFrame, folder: str, checkpoint: str, changed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query over a stream of (path, text, mtime); ``changed`` gets the new and changed notes of each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        latest = rows.groupBy("path").agg(F.max_by("text", "mtime").alias("text"))
        old = manifest(spark, folder, before=number)
        new = hashes(latest)
        if changed is not None:
            due = new.join(old.withColumnRenamed("hash", "_old"), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("_old")))
            changed(latest.join(due.select("path"), "path", "left_semi"), number)
        merge_rows(old, new, ["path"]).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return notes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of events by type and window, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n"))
