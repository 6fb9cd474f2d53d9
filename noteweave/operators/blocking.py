"""Near-duplicate entity blocking: a slice against all, clusters, balanced chunks and packed batches."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.functions.vectors import dot
from noteweave.operators.storage import numbered, written

SIMILARITY, TOP_K, MAX_CLUSTER, SLICE, PER_CALL, BACKSTOP_DAYS = 0.85, 5, 10, 200, 40, 14
#: Items of one block when batches are packed; a batch has fewer.
BLOCK_ITEMS = 4096


def select_slice(rows: DataFrame, cursor: str | None, limit: int = SLICE, backstop: bool = True) -> DataFrame:
    """(path) of the next ``limit`` rows (path, checked): unchecked ones first; then, where the backstop is due, checked ones
    by path from behind the cursor, cyclically."""
    rows = rows if backstop else rows.filter(~F.col("checked"))
    behind = F.col("checked") & (F.col("path") <= cursor) if cursor is not None else F.lit(False)
    return rows.orderBy(F.col("checked").cast("int"), behind.cast("int"), "path").limit(limit).select("path")


def next_cursor(rows: DataFrame, part: DataFrame, cursor: str | None) -> str | None:
    """The cursor after a slice: the last checked path that it took, cyclically from the old one; the old one if it took
    none."""
    taken = rows.filter("checked").join(part, "path", "left_semi")
    behind = F.col("path") <= cursor if cursor is not None else F.lit(False)
    last = taken.orderBy(behind.cast("int").desc(), F.desc("path")).first()
    return cursor if last is None else last.path


def backstop_due(last: str | None, now: datetime.datetime, days: int = BACKSTOP_DAYS) -> bool:
    """Whether whole ``days`` have passed since ``last`` (YYYY-MM-DD HH:MM:SS); without a mark the clock has not started."""
    return last is not None and (now - datetime.datetime.strptime(last, "%Y-%m-%d %H:%M:%S")).days >= days


def knn_pairs(vectors: DataFrame, part: DataFrame, threshold: float = SIMILARITY, k: int = TOP_K) -> DataFrame:
    """(a, b): for each path of ``part`` (a bounded slice, sent to all tasks) its ``k`` nearest of the same folder at or
    above the threshold, as sorted pairs."""
    unit = vectors.withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    left = part.join(unit, "path").select(F.col("path").alias("p"), F.col("folder").alias("f"), F.col("vec").alias("v"), F.col("norm").alias("m"))
    near = unit.join(F.broadcast(left), (F.col("folder") == F.col("f")) & (F.col("path") != F.col("p")))
    norms = F.col("norm") * F.col("m")
    near = near.withColumn("cos", F.when(norms > 0, dot(F.col("v"), F.col("vec")) / norms).otherwise(F.lit(0.0))).filter(F.col("cos") >= threshold)
    first = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("cos"), F.desc("path"))) <= k
    return near.withColumn("_in", first).filter("_in").select(F.least("p", "path").alias("a"), F.greatest("p", "path").alias("b")).distinct()


def balanced_chunks(members: DataFrame, group: str, most: int = MAX_CLUSTER) -> DataFrame:
    """``members`` with chunk: each group, of any size, cut in as few even parts of at most ``most``, the larger ones first."""
    rows = numbered(members, [group], ["path"], "_i")
    parts = F.ceil(F.col("_i_of") / most)
    base, extra = F.floor(F.col("_i_of") / parts), F.col("_i_of") % parts
    at = F.when(F.col("_i") < extra * (base + 1), F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor((F.col("_i") - extra * (base + 1)) / base))
    return rows.withColumn("chunk", at.cast("int")).drop("_i", "_i_of")


def pack_batches(sizes: DataFrame, most: int = PER_CALL) -> DataFrame:
    """(seq, size, batch): items (sizes of 1 or more) in order of seq put into batches of at most ``most``, none split; one
    that is larger is alone.

    An item's batch, if it began one, would end before the first item that it has no room for, at most ``most`` items on;
    these jumps, doubled, mark the items that do begin batches in rounds as the logarithm of their number."""
    rows = numbered(sizes.select("seq", F.col("size").cast("long").alias("size")), [], ["seq"], "i")
    # items and the ones behind them share a block or neighbour blocks
    block = F.floor(F.col("i") / BLOCK_ITEMS)
    spread = rows.withColumn("block", F.explode(F.array(block, block - 1))).withColumn("own", F.floor(F.col("i") / BLOCK_ITEMS) == F.col("block"))
    ahead = Window.partitionBy("block").orderBy("i").rowsBetween(Window.currentRow, min(most, BLOCK_ITEMS - 1))
    room = F.aggregate(F.collect_list("size").over(ahead), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("open")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + F.when(s["open"] & (s["sum"] + x <= most), 1).otherwise(0)).alias("n"), (s["open"] & (s["sum"] + x <= most)).alias("open")))
    jumps = written(spread.withColumn("n", F.greatest(room["n"], F.lit(1))).filter("own").select("i", (F.col("i") + F.col("n")).alias("to"), F.lit(1).cast("long").alias("steps")), "jumps")
    marks = written(rows.filter("i = 0").select("i", F.lit(0).cast("long").alias("batch")), "marks")
    total = rows.count()
    while True:
        on = marks.join(jumps, "i").select(F.col("to").alias("i"), (F.col("batch") + F.col("steps")).alias("batch")).filter(F.col("i") < total)
        grown = written(marks.union(on).groupBy("i").agg(F.min("batch").alias("batch")), "marks")
        if grown.count() == marks.count():
            break
        marks = grown
        far = jumps.select(F.col("i").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        jumps = written(jumps.join(far, "to", "left").select("i", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), "jumps")
    # an item is in the batch that the last mark at or before it begins, at most ``most`` items back
    marked = rows.join(marks, "i", "left").withColumn("block", F.explode(F.array(block, block + 1))).withColumn("own", F.floor(F.col("i") / BLOCK_ITEMS) == F.col("block"))
    behind = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("batch", F.last("batch", ignorenulls=True).over(behind)).filter("own").select("seq", "size", F.col("batch").cast("int").alias("batch"))
