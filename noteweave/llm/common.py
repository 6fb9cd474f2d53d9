"""Shared helpers: tables, the shared work folder, sizing, and column-name hygiene."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of input that one task should take in; text grows about twofold when it is decompressed.
TASK_BYTES = 32 << 20
#: Catalyst's estimate where it knows nothing is beyond this.
UNKNOWN_BYTES = 1 << 60
MOST_PARTITIONS = 1 << 17
#: Bytes of a row group of intermediate tables: what a task holds of one while it writes or reads.
ROW_GROUP = 16 << 20
#: Rows (of a key and a number or two) that may be sent to all executors.
BROADCAST_ROWS = 200_000
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a filter of rows that is sent to all executors: for each row, and at most (16 MB).
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session. Where it is unset and everything runs in one
    process (tests), a temporary folder is made once and kept in the session's settings; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("noteweave.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noteweave-")
        spark.conf.set("noteweave.shared.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/noteweave/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors. What was
    shuffled for it goes from the executors' disks as soon as it is written, not when the driver collects its garbage."""
    path = work_path(df.sparkSession, tag)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        # the setting is read when a plan is made, so by the table's own writing only
        df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.noteweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "noteweave_path", None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def attach(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row for each key. It is written first: sent to all executors if it has at most
    ``BROADCAST_ROWS`` rows, else joined as a plain table, so Spark can split a key that many rows have."""
    few = materialise(few, "few")
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    return rows.join(few, keys, how)


def mostly_in(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is in ``few``, and some others: a filter by one bit for each hash, of bounded
    size, so that an exact join need not shuffle all of them."""
    bits = min(MOST_FILTER_BITS, 1 << max(15, (FILTER_BITS * few.count()).bit_length()))
    bucket, held = fresh(rows, "bucket", "held")
    spot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    maps = few.select(F.bitmap_bucket_number(spot).alias(bucket), F.bitmap_bit_position(spot).alias(held)).groupBy(bucket).agg(F.bitmap_construct_agg(held).alias(held))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn(bucket, F.bitmap_bucket_number(spot)).join(F.broadcast(maps), bucket)
    return joined.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def row_place(docs: DataFrame) -> list[Column] | None:
    """(part, file, row): where a row of a table read from files stands, in an order that outlives reading again: the
    number in the file's name, the name, and the row in the file. None for other tables."""
    if any(c.lower() == "_metadata" for c in docs.columns):
        return None
    name = F.col("_metadata.file_name")
    found = [F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(-1).cast("long")), name, F.col("_metadata.row_index")]
    try:
        docs.select(*found).schema  # noqa: B018
    except AnalysisException:
        return None
    return found


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` (written) with their rank from 0 in ``order``: a range sort, and prefix sums over its partitions."""
    at, spot = fresh(rows, "at", "spot")
    rows = materialise(rows.orderBy(*order).withColumns({at: F.spark_partition_id(), spot: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = rows.groupBy(at).agg(F.count(F.lit(1)).alias("_n")).select(at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), at).withColumn(name, F.col("_base") + F.col(spot)).drop(at, spot, "_base")


#: What Python workers keep between tasks, by operator: how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """An operator keeps tables in its workers while its tasks follow one another; ``forget`` empties them."""
    _kept[operator] = forget


def begin(operator: str) -> None:
    """At the start of a task in a Python worker: what other operators have left in it goes."""
    others = [forget for name, forget in _kept.items() if name != operator]
    for forget in others:
        forget()
    release()


def release() -> None:
    """Give memory that nothing uses back to the machine, which other workers and the JVM share."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Shuffle partitions for all of ``df``: the session's number, or more where a task would take too much."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    if size >= UNKNOWN_BYTES:
        return least
    return max(least, min(MOST_PARTITIONS, math.ceil(size / task_bytes)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        got = f"_{name}"
        while got.lower() in taken:
            got = f"_{got}"
        taken.add(got.lower())
        out.append(got)
    return out


def text_of(column: str = "text"):
    """The text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def groups(batches, keys: int):
    """Runs of equal leading ``keys`` columns in a sorted stream of Arrow batches: (key values, table of the run)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = None
        for c in batch.columns[:keys]:
            differs = pc.invert(pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False))
            change = differs if change is None else pc.or_(change, differs)
        starts = [0, *(i + 1 for i, x in enumerate(change.to_pylist()) if x), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and key != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


class Forest:
    """Union-find over small integers; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def words64(column) -> list:
    """The values of an Arrow binary column as arrays of unsigned 64-bit integers, without copies; null as empty."""
    import numpy as np

    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    if data is None or at[-1] == at[0]:
        return [np.zeros(0, np.uint64)] * len(column)
    raw = np.frombuffer(data, np.uint8)
    return [raw[a:b].view(np.uint64) for a, b in zip(at, at[1:], strict=False)]
