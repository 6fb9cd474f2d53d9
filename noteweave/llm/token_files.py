"""Token-id files: flat unsigned integers and 64-bit document offsets, in ascending document order.

Documents are range-partitioned by (id, text hash, place in the files they are read from); each task writes one shard: ``NAME.bin`` (ids of all its documents,
16 bits wide where the vocabulary allows, else 32), ``NAME.off`` (n + 1 unsigned 64-bit token offsets within the shard)
and ``NAME.doc`` (n signed 64-bit document ids). The first token of a shard in the whole corpus, its base, is the prefix
sum of the shards' counts; the manifest holds one row for each shard. Readers map the files into memory; a file in a
store that has no local files is first copied to the reading task's own scratch file, a block at a time, and mapped there.

Files appear under their own names only when complete, so a task that runs again just replaces them; what attempts that
failed have left is removed when the manifest is written.

Defined cases: a null text is an empty one and gives the end id alone; a very long text is encoded whole; null ids come
first and stay null; rows that share an id are ordered by the hash of their text, equal rows by their place; an empty
table gives no shards; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import mmap
import shutil
import tempfile
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import common
from noteweave.llm.encoding import encoder

#: Texts handed to the tokenizer at once.
BATCH_ROWS = 1000
MANIFEST = "shard long, n_docs long, n_null long, n_tokens long, width int, path string"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def _put(fs: pafs.FileSystem, path: str, attempt: int, write) -> None:
    """Write under another name, then move."""
    with fs.open_output_stream(f"{path}.{attempt}") as out:
        write(out)
    fs.move(f"{path}.{attempt}", path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> list[dict]:
    """Write the shards of ``docs`` and the manifest into ``folder`` (a URI all executors can open); return the manifest:
    a row for each shard, in order, with its ``base``."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    place = common.row_place(docs)
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), common.text_of(text_column).alias("text"), (F.xxhash64(*place[1:]) if place else F.monotonically_increasing_id()).alias("place")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(common.partitions_for(docs), "doc", "tie", "place").sortWithinPartitions("doc", "tie", "place").select("doc", "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        path = f"{root}/shard-{task:07d}"
        encode = encoder(tokenizer, width).encode
        end = end_id.to_bytes(width, "little")
        docs, counts, n_null = [], [], 0
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return

        def ids(out) -> None:
            nonlocal n_null
            for batch in chain([first], batches):
                n_null += take(batch, out)

        def take(batch: pa.RecordBatch, out) -> int:
            for part in _slices(batch):
                for got in encode(part.column(1).to_pylist()):
                    out.write(got + end)
                    counts.append(len(got) // width + 1)
            docs.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            return batch.column(0).null_count

        _put(fs, f"{path}.bin", attempt, ids)
        offsets = np.zeros(len(counts) + 1, "<u8")
        np.cumsum(counts, out=offsets[1:])
        _put(fs, f"{path}.off", attempt, lambda out: out.write(offsets.tobytes()))
        _put(fs, f"{path}.doc", attempt, lambda out: out.write(np.concatenate(docs).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_pylist([{"shard": task, "n_docs": len(counts), "n_null": n_null, "n_tokens": int(offsets[-1]), "width": width, "path": f"shard-{task:07d}"}], schema=_MANIFEST_ARROW)

    # one short row for each shard, whatever the number of documents
    shards = sorted((r.asDict() for r in ordered.mapInArrow(shard, MANIFEST).collect()), key=lambda r: r["shard"])
    base = 0
    for row in shards:
        row["base"] = base
        base += row["n_tokens"]
    _put(fs, f"{root}/manifest.json", 0, lambda out: out.write(json.dumps(shards).encode()))
    for found in fs.get_file_info(pafs.FileSelector(root)):
        if found.type == pafs.FileType.File and found.base_name.rpartition(".")[2].isdigit():
            fs.delete_file(found.path)  # of an attempt that failed
    return shards


_MANIFEST_ARROW = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("path", pa.string())])


def manifest(folder: str) -> list[dict]:
    fs, root = _filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array mapped into memory, from a scratch copy where its store has no local files."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(path).read_buffer(), kind)
    with tempfile.TemporaryFile() as scratch:  # goes with the map
        with fs.open_input_stream(path) as f:
            shutil.copyfileobj(f, scratch, 1 << 22)
        size = scratch.tell()
        scratch.flush()
        return np.frombuffer(mmap.mmap(scratch.fileno(), size, access=mmap.ACCESS_READ) if size else b"", kind)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files: doc_id, start (its first token in the whole corpus), ids (array of long)."""

    def ids(part: np.ndarray):
        return part.astype("<i8")

    return _read(spark, folder, "ids array<long>", lambda parts: [pa.array(list(map(ids, parts)), pa.list_(pa.int64()))])


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned
    32-bit integers)."""

    def columns(parts: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.astype("<u4")) for p in parts], pa.int64())]

    return _read(spark, folder, "n_tokens long, ids_crc32 long", columns)


def _read(spark: SparkSession, folder: str, fields: str, columns) -> DataFrame:
    shards = manifest(folder)
    schema = f"doc_id long, start long, {fields}"
    if not shards:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(r["path"], r["base"], r["n_null"], r["width"]) for r in shards], "path string, base long, n_null long, width int").repartition(len(shards), "path")
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['path']}"
                ids, offsets, docs = _mapped(fs, f"{path}.bin", f"<u{row['width']}"), _mapped(fs, f"{path}.off", "<u8").astype("<i8"), _mapped(fs, f"{path}.doc", "<i8")
                for at in range(0, len(docs), 2000):
                    to = min(at + 2000, len(docs))
                    parts = [ids[offsets[i] : offsets[i + 1]] for i in range(at, to)]
                    doc = pa.array(docs[at:to], mask=np.arange(at, to) < row["n_null"])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(row["base"] + offsets[at:to]), *columns(parts)], names=names)

    return rows.mapInArrow(read, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.work_path(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_summaries(spark, folder)
