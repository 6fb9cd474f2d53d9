"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by key (text hash, id, file order). A sample of keys, each drawn with a chance in proportion to its
record's size, gives quantile splitters of many fine ranges; each record finds its range by binary search. Ranges that
turn out overfull are split anew by splitters sampled within them. Sizes are summed by range before anything is
gathered, a prefix sum places each range in the whole order, and a running sum within the small ranges places each
record; shard k holds the records whose middles lie in the k-th equal part of all bytes. So a shard misses its share by
half a record at either end, equal texts stand side by side, and a group of copies of any size is simply cut where a
shard is full.

Defined cases: a null text counts as empty; a very long text is one record, whose size is the most that shards differ by;
null ids come first; ties in hash and id are ordered as read; repeated rows each take their own slot; an empty table
gives no rows; all columns of the input are kept (shard, slot and size replace columns of those names).
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.llm import common

#: Bytes counted for a record besides its text.
RECORD_BYTES = 16
#: Rows of one fine range, and bounds on the number of ranges: the least keeps ranges small beside a shard, the most
#: bounds the splitters sent with each task.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 50_000, 512, 8192
#: Samples for each range.
OVERSAMPLE = 12
#: A range is overfull beyond this many times the mean.
OVERFULL = 3.0


def literal(splitters: list[tuple[int, int, int]]) -> Column:
    kind = "array<struct<h:bigint,d:bigint,o:bigint>>"
    return F.from_json(F.lit("[" + ",".join(f'{{"h":{h},"d":{d},"o":{o}}}' for h, d, o in splitters) + "]"), kind)


def range_of(key: Column, splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters not above ``key``, by binary search."""
    if not splitters:
        return F.lit(0)
    array, n = literal(splitters), len(splitters)
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]

    def step(at: Column, width: Column) -> Column:
        to = at + width
        return F.when((to <= n) & (F.get(array, F.least(to, F.lit(n)) - 1) <= key), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def quantiles(sample: list[tuple[int, int, int]], ranges: int) -> list[tuple[int, int, int]]:
    sample = sorted(sample)
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _sample(rows: DataFrame, chance: Column, seed: int) -> list[tuple[int, int, int]]:
    """Keys drawn with the given chances; callers bound the expected number."""
    return [tuple(r) for r in rows.filter(F.rand(seed) < chance).select("h", "d", "o").collect()]


def assign(records: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", carried: list[str] | None = None, seed: int = 7) -> DataFrame:
    """``records`` (of ``carried`` columns, or all) with size, shard (0 to ``shards`` - 1) and slot (0, 1, ... in each shard)."""
    kept = [c for c in (records.columns if carried is None else carried) if c.lower() not in ("size", "shard", "slot")]
    text = common.text_of(text_column)
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.xxhash64(text).alias("h"), F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("d"), (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"))
    rows = common.materialise(rows.withColumn("o", F.monotonically_increasing_id()), "records")  # the text is read once; the order outlives lost tasks
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return rows.select("row.*", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(total.n / RANGE_ROWS)))
    splitters = quantiles(_sample(rows, F.col("size") * (ranges * OVERSAMPLE / total.bytes), seed), ranges)
    key = F.struct("h", "d", "o")
    while True:  # ranges that are overfull are split, and looked at again
        sums = rows.groupBy(range_of(key, splitters).alias("range")).agg(F.sum("size").alias("bytes"))
        over = sums.filter(F.col("bytes") > OVERFULL * total.bytes / ranges).collect()  # ranges / OVERFULL rows at most
        if not over:
            break
        chances = F.coalesce(F.get(F.lit([float(OVERSAMPLE * 2 * ranges / total.bytes) if k in {r.range for r in over} else 0.0 for k in range(len(splitters) + 1)]), range_of(key, splitters)), F.lit(0.0))
        seed += 1
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for k in _sample(rows, F.col("size") * chances, seed):
            parts.setdefault(bisect_right(splitters, k), []).append(k)
        number = {r.range: math.ceil(r.bytes * ranges / total.bytes) for r in over}
        more = sorted({*splitters, *(s for r, keys in parts.items() for s in quantiles(keys, number[r]))})
        if len(more) == len(splitters):
            break  # single records that are larger than a range
        splitters = more
    ranged = rows.withColumn("range", range_of(key, splitters))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range: bounded by the splitters
    bases = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy("h", "d", "o")
    placed = (
        ranged.join(F.broadcast(bases), "range")
        .withColumn("begin", F.col("base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("shard", F.least(F.floor((F.col("begin") + F.col("size") / 2) * F.lit(float(shards)) / F.lit(float(total.bytes))), F.lit(shards - 1)).cast("int"))
        .withColumn("place", F.row_number().over(Window.partitionBy("range", "shard").orderBy("h", "d", "o")).cast("long"))
    )
    placed = common.materialise(placed, "placed")
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))  # ranges + shards rows at most
    first = counts.select("shard", "range", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    done = placed.join(F.broadcast(first), ["shard", "range"])
    return done.select("row.*", "size", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))


def write_shards(assigned: DataFrame, path: str, shards: int, rows_per_file: int = 1_000_000) -> None:
    """Write assigned records into one folder for each shard, in files of ``rows_per_file`` slots each."""
    part = F.floor(F.col("slot") / rows_per_file)
    n = max(shards, common.partitions_for(assigned))
    assigned.withColumn("part", part).repartitionByRange(n, "shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").parquet(path)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(common.text_of().cast("binary")).alias("text_crc32"))
    done = assign(docs, 40, carried=["doc_id", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
