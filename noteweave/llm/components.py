"""Connected components of a graph of any size: alternating large and small stars over DataFrames.

In each round every node's greater neighbours, then its smaller ones, are hung under the least node it knows. Each
round is written to the shared folder and the one before it deleted; rounds grow with the logarithm of the graph's size.

The least neighbours of a small graph are sent to all executors. Those of a large one are written first and joined as a
plain table, so Spark can split the edges of a hub among tasks.

Defined cases: null nodes and loops are no edges; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.llm import common


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v of one orderable type): the least node it reaches."""
    # v below u throughout
    edges = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.materialise(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        written: list[DataFrame] = [edges]

        def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
            """``least`` has at most two rows for each edge."""
            if mark[0] <= common.BROADCAST_ROWS:  # noqa: B023
                return rows.join(F.broadcast(least), "u")
            written.append(common.materialise(least, "least"))  # noqa: B023
            return rows.join(written[-1], "u")  # noqa: B023

        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both, least).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.materialise(small.union(least.select("u", "m")).distinct(), "small-star")
        common.discard(large, *written)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
