"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: lower case, compatibility forms, look-alike letters of other scripts and, within words, digits and signs that
stand for letters; everything but letters becomes one blank. Terms are word stems (" stem") or whole words (" word ").
Phrases in which a term is innocent are exceptions: matched by the same automaton, they cancel the terms inside them.
The weights of what remains, in total and by length, give a score from 0 to 1 by a logistic curve.

The lexicon, the exceptions and the curve are learned from labelled documents of the training folds, at most about
``TRAIN_ROWS`` of them, picked by hash. Copies are counted once (documents that share their least hash of three
words), so the words of one often-copied document do not pass for terms.

Terms are counted over all of that sample, whatever their number; what the driver holds of it is the terms in at least
``LEAST_TOXIC`` toxic documents, so their number is bounded by the sample's words.

Defined cases: null and empty texts have no match and get the curve's lowest score; very long texts are folded and matched
whole, in time proportional to their length; repeated rows score alike, and so do ties; rows that share an id are all
scored, and the one with the least text hash is learned from; without labelled documents of both kinds nothing is learned
and every score is 0; an empty table gives no rows; all columns of the input are kept unless they have the name of a new
one.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.llm import common

#: The most labelled rows that are learned from (in expectation; picked by hash).
TRAIN_ROWS = 24_000
#: A term occurs in so many different toxic documents, and so large a share of its documents is toxic.
LEAST_TOXIC, LEAST_SHARE = 7, 0.8
#: An exception occurs in so many different documents, none of them toxic.
LEAST_CLEAN = 3
#: Texts scored at once.
BATCH_ROWS = 500
#: Letters of a stem.
STEM = range(3, 9)
#: Log-likelihood ratio that a term needs.
LEAST_RATIO = 30.0
THRESHOLD = 0.7

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = str.maketrans("авеёіјкмнорѕтухԁһӏαβεηικνορτυχϲ", "abeeijkmhopstyxdhlabeniknoptuxc")
LEET = str.maketrans("0134578@$!|", "oieastbasil")

_OTHER_SCRIPT = re.compile("[Ͱ-ԯ]")
_MIXED = re.compile(r"[^\W\d_][0134578@$!|]|[0134578@$!|][^\W\d_]")
_TOKEN = re.compile(r"[\w@$!|]+")
_LAST_LETTER = re.compile(r".*[^\W\d_]", re.DOTALL)
_LEET_BEHIND = re.compile("[0134578@$]*")
_NO_LETTER = re.compile(r"[\W\d_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def _plain(token: re.Match) -> str:
    """A token in which digits and signs before a letter, and the run behind the last one, are the letters they stand for."""
    word = token[0]
    upto = _LAST_LETTER.match(word)
    if upto is None:
        return word
    end = _LEET_BEHIND.match(word, upto.end()).end()
    return word[:end].translate(LEET) + word[end:]


def fold(text: str) -> str:
    """The words of a text in folded form, each between single blanks."""
    text = text.lower()
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text).lower()
        if _OTHER_SCRIPT.search(text):
            text = _TOKEN.sub(lambda m: m[0].translate(LOOKALIKES) if re.search("[a-z]", m[0]) else m[0], text)
    if _MIXED.search(text):
        text = _TOKEN.sub(_plain, text)
    words = _NO_LETTER.sub(" ", text).strip()
    return f" {words} " if words else " "


def candidates(word: str) -> list[str]:
    """The terms that a word can match: its stems and itself."""
    return [f" {word[:k]}" for k in STEM if k <= len(word)] + [f" {word} "]


@dataclass
class Model:
    """terms: weight by term. exceptions: phrases. curve: intercept, weight of the total, weight of the rate."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.terms:
            return None
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, None))
        for term, weight in self.terms.items():
            found.add_word(term, (term, weight))
        found.make_automaton()
        return found

    def score(self, total: float, words: int) -> float:
        if not self.terms:
            return 0.0
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(total) + c * math.log1p(1000 * total / max(words, 1))))))


def matches(matcher: ahocorasick.Automaton | None, folded: str) -> list[tuple[int, str, float]]:
    """(place, term, weight) of the terms in a folded text: for each word its heaviest term, none within an exception."""
    if matcher is None:
        return []
    best: dict[int, tuple[str, float]] = {}
    innocent: list[tuple[int, int]] = []
    for end, (term, weight) in matcher.iter(folded):
        start = end - len(term) + 1
        if weight is None:
            innocent.append((start, end))
        elif start not in best or weight > best[start][1]:
            best[start] = (term, weight)
    innocent.sort()
    out, reach, k = [], -1, 0
    for start in sorted(best):
        while k < len(innocent) and innocent[k][0] <= start:
            reach = max(reach, innocent[k][1])  # the farthest end of an exception that begins here or before
            k += 1
        if start + len(best[start][0].rstrip()) - 1 > reach:
            out.append((start, *best[start]))
    return out


def _held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _signature(words: list[str]) -> int:
    """Least hash of three words in a row: alike for copies and most near copies, unlike for other texts."""
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return min(zlib.crc32(r.encode()) << 31 ^ zlib.adler32(r.encode()) for r in runs)


def _stream(df: DataFrame, schema: str, rows) -> DataFrame:
    """Apply ``rows`` (lists of columns, in batches, to an iterator of tuples) to ``df`` in Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("toxicity")
        out: list[tuple] = []
        parts = (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))
        for row in rows(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in parts):
            out.append(row)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 3 is not 1, and their texts in ``docs``."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > train_rows:
        share = int(train_rows / n * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < share)
    texts = docs.select("doc_id", common.text_of().alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")  # one row for each id

    def folded(batches):
        for batch in batches:
            for toxic, text in batch:
                done = fold(text)
                yield toxic, done, _signature(done.split())

    train = common.materialise(_stream(texts, "toxic int, folded string, mark long", folded).dropDuplicates(["mark", "toxic"]).select("toxic", "folded"), "toxic-train")
    kinds = {r.toxic > 0: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = kinds.get(True, 0), kinds.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()

    def terms(wanted: frozenset[str] | None):
        def count(batches):
            tally: Counter[str] = Counter()
            for batch in batches:
                for (text,) in batch:
                    found = {t for w in set(text.split()) for t in candidates(w)}
                    tally.update(found if wanted is None else found & wanted)
            yield from tally.items()

        return count

    def tally(toxic: bool, wanted: frozenset[str] | None, least: int) -> dict[str, int]:
        part = train.filter((F.col("toxic") > 0) == toxic).select("folded")
        sums = _stream(part, "term string, n long", terms(wanted)).groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {r.term: r.n for r in sums.collect()}

    toxic = tally(True, None, LEAST_TOXIC)
    clean = tally(False, frozenset(toxic), 1)
    chosen = _choose(toxic, clean, n_toxic, n_clean)
    model = Model(chosen)
    if not chosen:
        return model

    def phrases(batches):
        matcher = model.matcher()
        tally: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for is_toxic, text in batch:
                found = set()
                for at, _, _ in matches(matcher, text):
                    end = text.index(" ", at + 1)
                    word, after, before = text[at + 1 : end], text[end + 1 : text.find(" ", end + 1)] if end + 1 < len(text) else "", text[text.rfind(" ", 0, at) + 1 : at]
                    found |= {f" {word} ", f" {word} {after} " if after else "", f" {before} {word} " if before else ""}
                for p in found - {""}:
                    tally[p, int(is_toxic > 0)] += 1
        for (p, t), n in tally.items():
            yield p, n * t, n * (1 - t)

    sums = _stream(train.select("toxic", "folded"), "phrase string, toxic long, clean long", phrases).groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    innocent = sums.filter((F.col("clean") >= LEAST_CLEAN) & (F.col("toxic") == 0))
    model.exceptions = frozenset(r.phrase for r in innocent.collect())

    def features(batches):
        matcher = model.matcher()
        for batch in batches:
            for is_toxic, text in batch:
                yield int(is_toxic > 0), sum(m[2] for m in matches(matcher, text)), text.count(" ") - 1

    rows = _stream(train.select("toxic", "folded"), "y int, total double, words long", features).collect()  # train_rows at most
    model.curve = _fit(np.array([r.y for r in rows], float), np.array([r.total for r in rows]), np.array([r.words for r in rows], float))
    return model


def _choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights (log-odds) of the terms kept. A stem makes the longer terms that begin with it needless unless they are
    clearly purer; where nearly all its documents have one longer term, that one stands for it."""
    base = n_toxic / (n_toxic + n_clean)
    good = []
    for term, p in toxic.items():
        q = clean.get(term, 0)
        share = p / (p + q)
        ratio = 2 * (p * math.log(share / base) + (q * math.log((1 - share) / (1 - base)) if q else 0.0))
        if share >= LEAST_SHARE and ratio >= LEAST_RATIO:
            good.append((term, share, math.log((p + 0.5) / (n_toxic + 1)) - math.log((q + 0.5) / (n_clean + 1)), ratio))
    kept: dict[str, tuple[float, float, float]] = {}
    for term, share, weight, ratio in sorted(good, key=lambda x: (len(x[0].rstrip()), x[0])):
        stems = [kept[term[:k]] for k in range(2, len(term.rstrip()) + 1) if term[:k] in kept]
        if not any(share <= s + 0.02 for s, _, _ in stems):
            kept[term] = (share, weight, ratio)
    exact = {}
    for term, share, weight, ratio in sorted(good, key=lambda x: (-len(x[0]), x[0])):
        stem = next((term[:k] for k in range(2, len(term) + 1) if term[:k] in kept), None)
        if stem and stem not in exact and toxic[term] >= 0.97 * toxic[stem] and share >= kept[stem][0]:
            exact[stem] = (term, weight, ratio)
    chosen = {t: (w, r) for t, w, r in (exact.get(s, (s, *kept[s][1:])) for s in kept)}
    return {t: chosen[t][0] for t in sorted(chosen)}


def _fit(y: np.ndarray, total: np.ndarray, words: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, lightly regularised."""
    x = np.column_stack([np.ones_like(total), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1))])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.0) if (w[1:] < 0).all() else w[1:]
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, model: Model, text_column: str = "text", hits: bool = True, carried: list[str] | None = None) -> DataFrame:
    """``docs`` (of ``carried`` columns, or all) with score, n_words, weight (of all matches) and hits (place in the
    folded text, term)."""
    new = ["score", "n_words", "weight"] + ["hits"] * hits
    kept = [c for c in (docs.columns if carried is None else carried) if c.lower() not in new]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("term", pa.string())]))
    (text,) = common.fresh(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("toxicity")
        matcher = model.matcher()
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            out: list[list] = [[], [], [], []]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                folded = fold(text)
                found, words = matches(matcher, folded), max(0, folded.count(" ") - 1)
                total = sum(m[2] for m in found)
                for c, v in zip(out, (model.score(total, words), words, total, [{"at": at, "term": term} for at, term, _ in found]), strict=True):
                    c.append(v)
            arrays = [pa.array(out[0], pa.float64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays[: len(new)]], names=[*batch.schema.names[:-1], *new])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], common.text_of(text_column).alias(text))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, k in (("score", "double"), ("n_words", "long"), ("weight", "double"), ("hits", T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("term", T.StringType())])))):
        if name in new:
            schema = schema.add(name, k)
    return rows.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs, model, hits=False, carried=["doc_id"])
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words")
