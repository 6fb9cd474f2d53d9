"""Packing by power-of-two decomposition.

A document of n tokens (its end id included) is cut, in order, into n // longest pieces of the longest length and then
one piece for each bit of the rest, largest first. Every piece is a sequence of its own, of a power-of-two length: no
sequence crosses documents and none is padded. Sequences of equal length form a bucket; the ids of a bucket's sequences
follow one another in the order of the documents, so a batch is a run of ids and a training order of the documents (by
file and row, where the table is read from files) is that of the sequences of each length. Ids come from prefix sums
over (bucket, run of rows read by a task) counts; no task holds more than its own documents, and nothing is shuffled
but counts.

Defined cases: a null text is an empty one (the end id alone, one piece of length 1); a very long text gives as many
pieces of the longest length as it needs; repeated rows are packed as often as they occur, each with a number of its
own; an empty table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.llm import common
from noteweave.llm.encoding import encoder

LONGEST = 4096
BATCH_ROWS = 1000
#: part, file and first row tell runs of rows apart; nth and place count within a run: its documents, and its pieces of
#: a length.
RUN = ["part", "file", "first"]
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, bucket int, part long, file string, first long, nth long, place long"
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in PIECES.split(", "))])


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of a document of ``n`` tokens; ``longest`` is a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece, with its ids (little-endian unsigned 32-bit), its run of rows and its place there."""
    if longest < 1 or longest & longest - 1:
        raise ValueError(f"longest must be a power of two: {longest}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, 4).encode, end_id.to_bytes(4, "little")
        run, last, nth, places = None, -1, 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows = []
                ids_, texts, *where = (c.to_pylist() for c in part.columns)
                for doc, ids, number, file, row in zip(ids_, encode(texts), *where, strict=True):
                    if run is None or run[1] != file or row <= last:
                        run, nth, places = (number, file, row), 0, {}
                    last = row
                    ids += end
                    start, n = 0, len(ids) // 4
                    for k in lengths(n, longest):
                        place = places[k] = places.get(k, -1) + 1
                        rows.append((doc, start, k, n, ids[4 * start : 4 * (start + k)], k.bit_length() - 1, *run, nth, place))
                        start += k
                    nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    where = common.row_place(docs) or [F.lit(-1).cast("long"), F.lit(""), F.monotonically_increasing_id()]
    rows = docs.select(F.col(id_column).cast("long").alias("id"), common.text_of(text_column).alias("text"), *[c.alias(n) for c, n in zip(where, ("part", "file", "row"), strict=True)])
    return rows.mapInArrow(cut, PIECES)


def assign_sequences(pieces: DataFrame) -> DataFrame:
    """``pieces`` with sequence_id (0, 1, ... by bucket and order of the documents), offset (0) and document (0, 1, ...: the
    place of the piece's document in their order) instead of their runs and places."""
    pieces = common.materialise(pieces, "pieces")
    counts = common.materialise(pieces.groupBy("bucket", *RUN).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start") == 0).alias("docs")), "piece-counts")

    def before(value, *by: str):
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*RUN).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    first = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each power of two
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("_bucket"))
    # one row for each run: about as many as there are tasks
    runs = counts.groupBy(*RUN).agg(F.sum("docs").alias("docs")).select(*RUN, before("docs").alias("_docs"))
    bases = counts.withColumn("_run", before("n", "bucket")).join(F.broadcast(buckets), "bucket").join(runs, RUN).select("bucket", *RUN, (F.col("_bucket") + F.col("_run")).alias("_base"), "_docs")
    done = common.attach(pieces, bases, ["bucket", *RUN])
    return done.withColumns({"sequence_id": F.col("_base") + F.col("place"), "document": F.col("_docs") + F.col("nth"), "offset": F.lit(0).cast("long")}).drop(*RUN, "nth", "place", "_base", "_docs")


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST) -> DataFrame:
    """All pieces of ``docs``: doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset, document."""
    return assign_sequences(decompose(docs, tokenizer, end_id, longest))


def packed_digests(docs: DataFrame) -> DataFrame:
    """As ``pack`` with a checksum in place of the ids."""
    import public_tokenizers

    pieces = decompose(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    done = assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "document")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(common.table(spark, sf_dir, "documents"))
