"""Filing notes by the vote of their nearest labelled neighbours, moving them, and the journal of moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.functions import text as tx
from noteweave.operators.storage import written

NEIGHBOURS, THRESHOLD = 10, 0.7

#: Rows of one block of a vote: a task multiplies two blocks at once.
BLOCK = 2048


def _units(vectors: list) -> np.ndarray:
    """Unit vectors as rows, of the longest length; zero where a vector has no length."""
    wide = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def folder_vote(candidates: DataFrame, labelled: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(path, folder, share): the folder with the most similarity among each candidate's ``k`` nearest labelled rows, and
    its share of theirs; ties go to the folder of the nearest. All candidates meet all labelled rows, a block with a block,
    as a product of matrices; a product leaves ``k`` rows of each candidate, so what is shuffled grows with the rows times
    the other side's blocks. Similarities are compared to 12 digits, so equal ones tie."""
    sides = []
    for rows, side in ((candidates.select("path", "vec", F.lit(None).cast("string").alias("folder")), 0), (labelled.select("path", "vec", "folder"), 1)):
        rows = written(rows.filter(F.col("path").isNotNull() & F.col("vec").isNotNull()), "vote-side")
        blocks = max(1, -(-rows.count() // block))
        sides.append((rows.withColumns({"side": F.lit(side), "own": F.pmod(F.xxhash64("path"), F.lit(blocks))}), blocks))
    (left, n), (right, m) = sides
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumnsRenamed({"own": "i", "other": "j"})
    right = right.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnsRenamed({"other": "i", "own": "j"})
    columns = [F.col("i").cast("long"), F.col("j").cast("long"), "side", "path", "folder", F.col("vec").cast("array<double>").alias("vec")]
    tiles = left.select(*columns).union(right.select(*columns)).repartition("i", "j").sortWithinPartitions("i", "j", "side", "path")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != at and held:
                    yield product(held)
                    held = []
                at = row[:2]
                held.append(row[2:])
        if held:
            yield product(held)

    def product(rows: list[tuple]) -> pa.RecordBatch:
        a, b = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        x = _units([r[3] for r in rows])
        near = np.round(x[: len(a)] @ x[len(a) :].T, 12)  # labelled rows are in order of their paths
        place = {r[1]: j for j, r in enumerate(b)}
        out = []
        for i, r in enumerate(a):
            if r[1] in place:
                near[i, place[r[1]]] = 0.0
            some = np.flatnonzero(near[i] > 0)
            best = some[np.argsort(-near[i, some], kind="stable")[:k]]
            out += [(r[1], b[j][1], b[j][2], float(near[i, j])) for j in best.tolist()]
        names, kinds = ["p", "path", "folder", "sim"], [pa.string(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=names)

    near = tiles.mapInArrow(products, "p string, path string, folder string, sim double")
    top = near.withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("sim"), "path"))).filter(F.col("place") <= k)
    votes = top.groupBy("p", "folder").agg(F.sum("sim").alias("mass"), F.min("place").alias("first"))
    by = Window.partitionBy("p")
    rank = F.row_number().over(by.orderBy(F.round("mass", 9).desc(), "first"))
    votes = votes.withColumn("rank", rank).withColumn("total", F.sum("mass").over(by)).filter("rank = 1")
    return votes.select(F.col("p").alias("path"), "folder", (F.col("mass") / F.col("total")).alias("share"))


def decisions(candidates: DataFrame, votes: DataFrame, duplicates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, folder, share, action): skip, propose or move. candidates: path, current (null at the root), stem."""
    rows = candidates.join(votes, "path", "left").join(duplicates.select("stem", F.lit(True).alias("_dup")), "stem", "left")
    action = (
        F.when(F.col("folder").isNull() | F.col("folder").eqNullSafe(F.col("current")), "skip")
        .when(F.col("share") < threshold, F.when(F.col("current").isNull(), "propose").otherwise("skip"))
        .when(F.coalesce("_dup", F.lit(False)), "propose")
        .otherwise("move")
    )
    return rows.select("path", "folder", "share", action.alias("action"))


def latest_move(journal: DataFrame) -> DataFrame:
    """For each target the last journal entry that is not undone: seq, source, to."""
    last = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("seq"))) == 1
    return journal.filter(~F.col("undone")).withColumn("_last", last).filter("_last").drop("_last")


def apply_moves(notes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``notes`` (path, text) after ``moves`` (source, to), with links by path rewritten in every note, and (path, source,
    to, count) of the rewritten links: what an undo needs. A link names a path without ``.md``."""
    bare = lambda c: F.regexp_replace(c, r"\.md$", "")
    linked = notes.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(tx.LINK), F.lit(1)))).alias("_target"))
    hits = written(linked.join(moves.select("source", "to", bare("source").alias("_target")), "_target").select("path", "source", "to"), "hits")
    todo = hits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(bare("source").alias("a"), bare("to").alias("b")))).alias("_todo"))  # of one note
    rows = notes.join(todo, "path", "left")
    # every link mark of a note is looked up once, so no rewritten link is rewritten again
    pieces = F.split("text", r"(?=\[\[)")

    def rewritten(piece):
        target = F.regexp_extract(piece, rf"^{tx.LINK}(?=[\]|#])", 1)
        to = F.get(F.filter("_todo", lambda t: t["a"] == target), 0)["b"]
        return F.when(to.isNotNull(), F.concat(F.lit("[["), to, F.substr(piece, F.length(target) + 3))).otherwise(piece)

    text = F.when(F.col("_todo").isNotNull(), F.array_join(F.transform(pieces, rewritten), "")).otherwise(F.col("text"))
    counts = notes.join(hits, "path").withColumn("count", F.size(F.filter(F.regexp_extract_all("text", F.lit(tx.LINK + r"(?=[\]|#])"), F.lit(1)), lambda t: t == bare("source")))).filter("count > 0").select("path", "source", "to", F.col("count").cast("long").alias("count"))
    moved = rows.withColumn("text", text).join(moves.select(F.col("source").alias("path"), "to"), "path", "left")
    return moved.withColumn("path", F.coalesce("to", "path")).select(*notes.columns), counts


def transfer(table: DataFrame, moves: DataFrame) -> DataFrame:
    """A manifest table (path, ...) with moved notes' entries, hashes and failures alike, under their new paths."""
    return table.join(moves.select(F.col("source").alias("path"), "to"), "path", "left").withColumn("path", F.coalesce("to", "path")).select(*table.columns)


def undo(journal: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo the latest standing move to each of ``to`` (to): the journal with those entries marked, and the moves back
    (source, to), to be applied as any others."""
    last = latest_move(journal).join(to.select("to").distinct(), "to", "left_semi")
    marked = journal.join(last.select("seq", F.lit(True).alias("_now")), "seq", "left")
    marked = marked.withColumn("undone", F.col("undone") | F.coalesce("_now", F.lit(False))).select(*journal.columns)
    return marked, last.select(F.col("to").alias("source"), F.col("source").alias("to"))
