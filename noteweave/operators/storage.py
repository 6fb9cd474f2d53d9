"""Cutting lineage: tables written to the folder that all executors share; ranks of rows of any number."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in ``spark.checkpoint.dir``, read back. Where that is unset and everything runs in one process, a
    temporary folder serves; on a cluster that is an error."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("noteweave.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="noteweave-")
        spark.conf.set("noteweave.shared.dir", root)
    path = f"{root.rstrip('/')}/noteweave/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their rank from 0 by ``order`` within each of ``groups`` (or in all), and the group's rows as
    ``{name}_of``: a range sort, and prefix sums over the parts of each group that its partitions hold."""
    rows = written(rows.orderBy(*groups, *order).withColumns({"_part": F.spark_partition_id(), "_spot": F.monotonically_increasing_id()}), "sorted")
    parts = rows.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_spot").alias("_first"))
    every = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # a row for each partition of the sort
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(parts.select(*groups, "_part", (before - F.col("_first")).alias("_base"), F.sum("_n").over(every).alias(f"{name}_of")), "bases")
    return rows.join(bases, [*groups, "_part"]).withColumn(name, F.col("_spot") + F.col("_base")).drop("_part", "_spot", "_base")
