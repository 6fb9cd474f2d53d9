"""Ranked retrieval: BM25L, vectors, substrings, and their fusion by reciprocal ranks.

A keyword query reads the texts once: the query's terms are counted in each, and the counts, a narrow table, give the
corpus statistics (a single row) and the scores. Nothing is shuffled but partial sums and the best rows of each task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.functions import text as tx
from noteweave.functions.vectors import cosine
from noteweave.operators.storage import written

DEPTH, RRF_K = 50, 60
K1, B, DELTA = 1.5, 0.75, 0.5


def query_tokens(query: str) -> list[str]:
    return re.findall("[a-z0-9]+", query.lower())


def _counts(text: Column, names: list[str]) -> dict[str, Column]:
    """The number of tokens of a text, and of those that are each of ``names``."""
    low = F.lower(text)
    alone = {f"_tf{i}": F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")) for i, t in enumerate(names)}
    return {"_dl": F.regexp_count(low, F.lit("[a-z0-9]+")), **alone}


def bm25l(notes: DataFrame, query: str, depth: int = DEPTH, tie: str = "path", by: str | None = None, tf_factor: bool = True) -> DataFrame:
    """``notes`` (path, text) without the text, with score and rank, best first. Statistics are those of ``notes`` as
    filtered; a token that the query repeats counts as often. ``by``: ranks and depth hold within each value of that
    column. ``tf_factor``: whether a term's weight is multiplied by its count, or only counts where it occurs."""
    terms = query_tokens(query)
    names = list(dict.fromkeys(terms))
    kept = [c for c in notes.columns if c != "text"]
    counted = written(notes.select(*kept, *[c.alias(n) for n, c in _counts(F.col("text"), names).items()]), "term-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(names))])
    norm = 1 - B + B * F.col("_dl") / F.col("_avg")
    parts = []
    for t in terms:
        i = names.index(t)
        tf = F.col(f"_tf{i}")
        c = tf / norm
        idf = F.log(F.col("_n") + 1.0) - F.log(F.col(f"_df{i}") + 0.5)
        weight = idf * tf if tf_factor else idf
        parts.append(F.when(tf > 0, weight * (K1 + 1) * (c + DELTA) / (K1 + c + DELTA)).otherwise(F.lit(0.0)))
    score = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    found = counted.filter(reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(names))], F.lit(False)))
    scored = found.join(F.broadcast(stats)).withColumn("score", score).filter(F.col("score") > 0)  # one row of statistics
    return ranked(scored.select(*kept, "score"), [F.round("score", 9).desc(), tx.path_key(F.col(tie))], depth, by)


def ranked(rows: DataFrame, order: list[Column], depth: int, by: str | None = None) -> DataFrame:
    """The first ``depth`` rows by ``order``, of all or within each value of ``by``, with their rank from 1."""
    if by is not None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= depth)
    return rows.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector_rank(vectors: DataFrame, query: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``vectors`` (path, vec) by cosine to the single row of ``query`` (qvec); only positive ones."""
    scored = vectors.join(F.broadcast(query.limit(1))).withColumn("score", cosine(F.col("vec"), F.col("qvec"))).drop("qvec")
    return ranked(scored.filter(F.col("score") > 0), [F.col("score").desc(), F.col("path")], depth)


def substring_rank(notes: DataFrame, query: str, depth: int = DEPTH) -> DataFrame:
    """Notes whose title or any line holds the query, in plain path order."""
    wanted = F.lit(query.lower())
    title = F.contains(F.lower(tx.stem(F.col("path"))), wanted)
    line = F.exists(tx.lines(F.col("text")), lambda x: F.contains(F.lower(x), wanted))
    return ranked(notes.filter(title | line), [F.col("path")], depth)


def gated(rows: DataFrame, unless: DataFrame) -> DataFrame:
    """``rows`` if ``unless`` is empty, else none."""
    any_ = unless.limit(1).agg(F.count(F.lit(1)).alias("_any"))
    return rows.join(F.broadcast(any_)).filter(F.col("_any") == 0).drop("_any")


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(path, score, first_list, first_rank) of ranked lists (path, rank), best first by ``rrf_order``."""
    every = reduce(DataFrame.unionByName, [d.select("path", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list")) for i, d in enumerate(lists)])
    return every.groupBy("path").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first")).select("path", "score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def rrf_order() -> list[Column]:
    return [F.round("score", 12).desc(), F.col("first_list"), F.col("first_rank")]


def hybrid(notes: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, limit: int = 20, tie: str = "path") -> DataFrame:
    """(rank, path, excerpt): keyword and vector ranks fused; substrings stand in where no keyword matches. ``tie`` is the
    column of ``notes`` that orders equal keyword scores."""
    words = written(bm25l(notes, query, tie=tie).select("path", "rank"), "keyword-lane")  # DEPTH rows
    near = vector_rank(vectors.join(notes.select("path"), "path", "left_semi"), query_vector)
    lanes = [words, near] if not words.isEmpty() else [words, near, substring_rank(notes, query)]
    best = ranked(rrf(lanes), rrf_order(), limit).select("path", "rank")
    return notes.join(F.broadcast(best), "path").select("rank", "path", tx.excerpt(F.col("text"), F.col("path"), query).alias("excerpt"))
