"""Health: one row with a number for each metric, and the errors of those that could not be taken."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The metrics of a full report.
METRICS = ("stale_embeddings", "manifest_drift", "orphaned_entities", "cache_consistency", "pending_proposals", "invalid_sheet_rows", "pending_retirements", "sweep_errors")


def report(faults: dict[str, DataFrame]) -> DataFrame:
    """A column for each metric with the number of its rows, counted in one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n") for name, df in faults.items()]
    every = reduce(DataFrame.union, counts)
    return every.agg(*[F.max(F.when(F.col("metric") == name, F.col("n"))).alias(name) for name in faults])


def isolated(spark: SparkSession, faults: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(metric, n, error): each metric by itself, so one that fails does not hide the others."""
    out = []
    for name, rows in faults.items():
        try:
            out.append((name, rows().count(), None))
        except Exception as e:  # noqa: BLE001  the report says what went wrong
            out.append((name, None, f"{type(e).__name__}: {e}"[:300]))
    return spark.createDataFrame(out, "metric string, n long, error string")


def cache_faults(cached: DataFrame, gathered: DataFrame) -> DataFrame:
    """(path) of entities that only one of the cache's table and the notes has."""
    a, b = cached.select("path").distinct(), gathered.select("path").distinct()
    return a.join(b, "path", "left_anti").union(b.join(a, "path", "left_anti"))


def pending_proposals(organize: DataFrame, merges: DataFrame, earlier: DataFrame, ran: bool) -> DataFrame:
    """(path) of what waits for a word: filing decisions to be proposed, and merges, those of an earlier run where none ran."""
    return organize.filter("action = 'propose'").select("path").unionByName((merges if ran else earlier).select(F.col("canonical").alias("path")))
