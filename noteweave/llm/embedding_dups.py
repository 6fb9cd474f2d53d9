"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are compared within a label only. Copies (equal label and components) form a class that is compared once and
counts as often as it occurs. A label's classes are dealt into blocks by hash and every pair of blocks is a tile. In a
tile each unit vector u is rounded to int8 with its own scale, u = s q + e, and products of the q are exact integers;
|u.v - s t q.r| <= |e||t r| + |s q||f| + |e||f| bounds the error by the vectors' own residual lengths. Only pairs whose
product and bound reach the threshold are computed again in double precision. A tile returns its vectors' link counts
and a spanning forest of its links, never its pairs.

Defined cases: null, zero, or non-finite vectors, vectors with null components and rows without a label link with
nothing and are their own component; vectors of other lengths are not compared; repeated rows are linked copies; a row
without an id counts, but is never named as a component unless it stands alone; ties at the threshold are links; an
empty table gives no rows; other columns, a text of any length among them, are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import common
from noteweave.llm.components import connected_components

THRESHOLD = 0.93
#: Classes of one block.
BLOCK = 2048
#: Longest vectors whose int8 products float32 sums hold exactly.
EXACT_DIM = (1 << 24) // (127 * 127)


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and residual lengths of unit vectors."""
    scale = np.abs(units).max(axis=1) / 127.0
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(units - scale[:, None] * codes, axis=1)


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that can reach the threshold by the codes and their bounds."""
    (p, s, e), (q, t, f) = a, b
    dots = np.zeros((len(p), len(q)))
    for at in range(0, p.shape[1], EXACT_DIM):
        dots += p[:, at : at + EXACT_DIM].astype(np.float32) @ q[:, at : at + EXACT_DIM].astype(np.float32).T
    near = s[:, None] * t[None, :] * dots
    # a rounded unit vector is at most as long as 1 plus its residual
    slack = e[:, None] * (1 + f)[None, :] + (1 + e)[:, None] * f[None, :] + (e[:, None] * f[None, :]) + 1e-9
    return np.nonzero(near + slack >= threshold)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine is at least the threshold."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    i, j = possible(quantise(x / nx[:, None]), quantise(y / ny[:, None]), threshold)
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        k = slice(at, at + (1 << 16))
        keep[k] = np.einsum("nd,nd->n", x[i[k]], y[j[k]]) / (nx[i[k]] * ny[j[k]]) >= threshold
    return i[keep], j[keep]


def classes_of(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """Rows (id, label, dim, class, vector) of ``vectors``; class and vector are null where nothing can be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("embedding_dups")
        for batch in batches:
            dims, classes, packed = [], [], []
            column = batch.column(2)
            # all components of the batch as one array; nulls within vectors become NaN, so they are not finite
            flat = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy()
            for label, given, at, to in zip(batch.column(1).to_pylist(), column.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                x = flat[at:to] + 0.0  # no negative zeros
                ok = label is not None and given and bool(np.isfinite(x).all()) and bool(x.any())
                if ok:  # lengths stay within doubles; a power of two changes no digit
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).astype("<f8", copy=False)
                data = x.tobytes() if ok else None
                dims.append(len(x) if ok else None)
                classes.append(xxhash.xxh3_128_digest(data + b"|" + label.encode()) if ok else None)
                packed.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(classes, pa.binary()), pa.array(packed, pa.binary())], names=["id", "label", "dim", "class", "vector"])

    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, label string, dim int, class binary, vector binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = common.materialise(classes_of(vectors, id_column, vector_column, label_column), "vectors")
    known = rows.filter(F.col("class").isNotNull())
    # copies meet as one row from each task
    classes = common.materialise(known.groupBy("class").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")), "classes")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = common.attach(classes, counts, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = each.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "copies", "vector")
    tiles = tiles.repartition(max(common.partitions_for(classes), 1), "label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "block", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, i, j), tile in common.groups(batches, 4):
            names, copies = tile.column("class").to_pylist(), tile.column("copies").to_numpy()
            x = np.frombuffer(b"".join(tile.column("vector").to_pylist()), "<f8").reshape(-1, dim)
            split = int((tile.column("block").to_numpy() == i).sum())
            first, second = (slice(0, split), slice(0, split) if i == j else slice(split, None))
            links = np.zeros(len(names), np.int64)
            forest = common.Forest(len(names))
            for at in range(0, split, 512):  # rows of the product held at once
                part = slice(at, min(at + 512, split))
                a, b = linked(x[part], x[second], threshold)
                a, b = a + at, b + (second.start or 0)
                if i == j:
                    a, b = a[a < b], b[a < b]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for u, v in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(u, v)
            out = [(names[k], None, int(links[k])) for k in np.flatnonzero(links)] + [(names[u], names[v], 0) for u, v in forest.links]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["u", "v", "n"])

    found = common.materialise(tiles.mapInArrow(run, "u binary, v binary, n long"), "tile-links")
    links = found.filter(F.col("v").isNull()).groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("n"))
    components = connected_components(found.filter(F.col("v").isNotNull()).select("u", "v"))
    placed = classes.select("class", "copies", "least").join(components.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed = common.materialise(placed, "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = common.attach(placed, least, ["component"]).join(links, "class", "left").select("class", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = rows.select(F.col("id").alias("vec_id"), "class").join(named, "class", "left")
    done = done.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
