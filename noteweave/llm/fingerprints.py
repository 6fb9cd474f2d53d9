"""Document fingerprints by content-defined chunking.

A text's UTF-8 bytes run through a gear hash of 32 bits, which depends on the last 32 bytes alone, so boundaries move
along with the text around an edit. Chunking is normalised: below the normal chunk length a boundary needs more zero
bits than above it, between a least and a most length. The fingerprint is the set of chunk digests with their lengths;
a chunk that repeats counts once. Likeness of two fingerprints is containment weighted by length: the bytes of the
chunks they share over the bytes of the smaller set.

Neighbours (each document's next by descending id) come from range partitions of the keys (id, text hash, place in the
files): splitters are quantiles of a bounded sample, and a copy of the greatest document below each range is sent along
with the range, so every task finds its neighbours in its own sorted rows, whatever ids repeat.

Defined cases: a null text is an empty one, whose fingerprint is empty; a very long text is hashed in overlapping blocks;
two empty fingerprints are alike (1), an empty and another are not (0); null ids come last in descending order; rows that
share an id are ordered by text hash, equal rows by their place; one row alone is its own next; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import common, sharding

#: Chunk lengths in bytes, and the zero bits a boundary needs below and above the normal length.
LEAST, NORMAL, MOST = 8, 24, 64
STRICT_BITS, LOOSE_BITS = 5, 3
#: Keys sampled for each range, and the most ranges, whose ends the driver holds.
SAMPLES, MOST_RANGES = 20, 8192
#: Bytes of text hashed at once; longer texts go in blocks that overlap by the gear hash's window.
BLOCK = 1 << 22

#: The gear table: 32 bits for each byte, from a hash of the byte's value.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear" + bytes([b])).digest()[:4], "little") for b in range(256)], "<u4")
_WINDOW = 32
#: Stands for no id.
FLOOR = -(2**63)


def gear(data: bytes) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + table[byte] modulo 2 ** 32, by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < _WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    strict, loose = [], []
    for at in range(0, n, BLOCK):
        lead = min(at, _WINDOW)
        h = gear(data[at - lead : at + BLOCK])[lead:] >> np.uint32(32 - STRICT_BITS)
        easy = np.flatnonzero(h < 1 << (STRICT_BITS - LOOSE_BITS))
        loose.append(easy + at + 1)
        strict.append(easy[h[easy] == 0] + at + 1)
    strict, loose = (np.concatenate(x).tolist() if x else [] for x in (strict, loose))
    ends, start, i, j = [], 0, 0, 0
    find = bisect.bisect_left
    while n - start > LEAST:
        limit = min(start + MOST, n)
        i = find(strict, start + LEAST, i)
        if i < len(strict) and strict[i] < start + NORMAL:
            end = strict[i]
        else:
            j = find(loose, start + NORMAL, j)
            end = loose[j] if j < len(loose) and loose[j] < limit else limit
        ends.append(min(end, n))
        start = ends[-1]
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Chunk lengths in bytes by 48-bit chunk digest."""
    data = text.encode("utf-8", "surrogatepass")
    out, start, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in cut_points(data):
        out[digest(data[start:end]) & 0xFFFFFFFFFFFF] = end - start
        start = end
    return out


def encode_set(chunks: dict[int, int]) -> str:
    """A fingerprint as text: base64 of sorted 8-byte records, the digest's 48 bits above the length's 16."""
    records = np.fromiter((d << 16 | n for d, n in chunks.items()), np.uint64, len(chunks))
    records.sort()
    return base64.b64encode(records.astype(">u8").tobytes()).decode("ascii")


def decode_set(fingerprint: str) -> dict[int, int]:
    records = np.frombuffer(base64.b64decode(fingerprint), ">u8").tolist()
    return {r >> 16: r & 0xFFFF for r in records}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes of shared chunks over the bytes of the smaller set."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(a[d] for d in a.keys() & b.keys())
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode_set(chunk_set(t)) for t in texts])], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_column).cast("long"), common.text_of(text_column)).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (f.split() for f in COMPARED.split(", "))])


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, text, ghost, range) of ``docs`` in ranges of keys, the rows of a range in one partition, sorted; before
    them comes, as a ghost, the row that precedes them in ascending order (for the first range, the greatest of all)."""
    place = common.row_place(docs)
    key = F.struct(F.coalesce(F.col(id_column).cast("long"), F.lit(FLOOR)).alias("h"), F.xxhash64(common.text_of(text_column)).alias("d"), (F.xxhash64(*place[1:]) if place else F.lit(0).cast("long")).alias("o"))
    rows = docs.select(key.alias("key"), common.text_of(text_column).alias("text"))
    ranges = min(MOST_RANGES, common.partitions_for(docs))
    n = docs.count()
    if not n:
        return rows.select("key.h", "text", F.lit(0).alias("ghost"), F.lit(0).alias("range")).withColumnRenamed("h", "id")
    sample = rows.filter(F.rand(5) < min(1.0, ranges * SAMPLES / n)).select("key.*").collect() if ranges > 1 else []
    splitters = sharding.quantiles([tuple(r) for r in sample], ranges)
    number = sharding.range_of(F.col("key"), splitters)
    # ranges have one row each here; the rest is arithmetic on their ends
    ends = sorted((r.range, tuple(r.last)) for r in rows.groupBy(number.alias("range")).agg(F.max("key").alias("last")).collect())
    following = {a: b for (a, _), (b, _) in zip(ends, ends[1:] + ends[:1], strict=True)}
    last = dict(ends)
    nobody = (FLOOR, 0, 0)
    lasts = sharding.literal([last.get(k, nobody) for k in range(len(splitters) + 1)])
    goes_on = F.lit([following.get(k, 0) for k in range(len(splitters) + 1)])
    placed = rows.withColumn("range", number)
    ghost = F.when(F.get(lasts, F.col("range")) == F.col("key"), F.array(F.struct(F.get(goes_on, F.col("range")).alias("range"), F.lit(1).alias("ghost"))))
    goes = F.concat(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost"))), F.coalesce(ghost, F.array().cast("array<struct<range:int,ghost:int>>")))
    sent = placed.select("key", "text", F.inline(goes))
    sent = sent.repartitionByRange(len(splitters) + 1, "range").sortWithinPartitions("range", F.desc("ghost"), "key")
    return sent.select(F.col("key.h").alias("id"), "text", "ghost", "range")


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document against its edit by the next document, and against the next document (descending ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("fingerprints")
        last: tuple[str, dict[int, int]] | None = None
        at = None
        for batch in batches:
            out: list[tuple] = []
            for doc, text, ghost, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    at, last = number, None
                if ghost:
                    last = (text, None)
                    continue
                chunks = chunk_set(text)
                following, other = last or (text, chunks)
                if other is None:
                    other = chunk_set(following)
                changed = edited(text, following)
                again = chunks if changed == text else chunk_set(changed)
                sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((None if doc == FLOOR else doc, len(text), sha, encode_set(chunks), encode_set(again), likeness(chunks, again), likeness(chunks, other)))
                last = (text, chunks)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return with_next(docs, id_column, text_column).mapInArrow(run, COMPARED)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(common.table(spark, sf_dir, "documents"))
