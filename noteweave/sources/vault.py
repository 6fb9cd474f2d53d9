"""Folders of markdown notes, vector files and journals as DataFrames, and writing notes back.

Everything is read and written by Spark, so a vault may be in any store that Spark reaches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from noteweave.functions import text as tx
from noteweave.operators import notes as nt

#: Folders that are never read; and what indexing leaves out: the graph, the caretakers' notes, top folders.
SKIP_DIRS = (".obsidian", ".trash", ".git")
GRAPH, CARETAKERS, IGNORED = "Claude/Graph/", ("Claude/Organizer.md", "Claude/Librarian.md"), ("copilot",)


def _relative(root: str):
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    return F.substr(path, F.lit(len(base) + 2))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIP_DIRS))))


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, mtime) of every note below ``root``; columns that are not used are not read. Notes whose names begin
    with ``_``, which Spark's sources hide, are added: sheets' schemas, a few. Folders that Spark hides are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rows = rows.select(_relative(root).alias("path"), "content", F.col("modificationTime").alias("mtime"))
    hidden = _underscored(spark, root)
    return _listed(rows.unionByName(hidden) if hidden is not None else rows)


def _underscored(spark: SparkSession, root: str) -> DataFrame | None:
    """As ``_files``, of the notes whose names begin with ``_``, read by the driver."""
    jvm = spark.sparkContext._jvm
    base = re.sub(r"([\\\[\]{}*?])", r"\\\1", root.rstrip("/"))
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath().rstrip("/")
    found, deeper = [], "/*"
    while True:
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}{deeper.removesuffix('/*')}/_*.md")) or []:
            path = status.getPath().toUri().getPath()[len(top) + 1 :]
            if not any(c.startswith((".", "_")) for c in path.split("/")[:-1]):
                stream = fs.open(status.getPath())
                try:
                    content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                finally:
                    stream.close()
                found.append((path, bytearray(content), status.getModificationTime()))
        if not len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}{deeper}/*")) or []):
            break
        deeper += "/*"
    if not found:
        return None
    return spark.createDataFrame(found, "path string, content binary, at long").select("path", "content", F.timestamp_millis("at").alias("mtime"))


@F.pandas_udf(StringType())
def _readable(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def read_notes(spark: SparkSession, root: str, folder: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """(path, text, mtime) of every note below ``root``, of a folder and with tags if they are given; bytes that are no UTF-8
    are dropped, replacement characters that a note holds are not. Only notes with such bytes go through Python."""
    rows = _files(spark, root)
    rows = rows if folder is None else rows.filter(F.col("path").startswith(folder.rstrip("/") + "/"))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    rows = rows.select("path", F.when(valid, text).otherwise(_readable(F.when(~valid, F.col("content")))).alias("text"), "mtime")
    return nt.with_tags(rows, tags or [])


def read_paths(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """(path, mtime) of the notes, whose contents are not read."""
    rows = _files(spark, root).select("path", "mtime")
    return rows if folder is None else rows.filter(F.col("path").startswith(folder.rstrip("/") + "/"))


def read_hashes(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, hash): SHA-256 of the raw bytes of every note that is indexed."""
    rows = _files(spark, root).filter(~F.col("path").startswith(GRAPH) & ~F.col("path").isin(*CARETAKERS) & ~tx.top_folder(F.col("path")).isin(*ignored))
    return rows.select("path", F.sha2("content", 256).alias("hash"))


def read_state(spark: SparkSession, path: str, default: dict) -> dict:
    """A caretaker's state file; the default where there is none, and a status that says so where it cannot be read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return dict(default)
    stream = fs.open(at)
    try:
        found = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        found = None
    finally:
        stream.close()
    return default | found if isinstance(found, dict) else {"status": "state file unreadable"}


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``tool_uses`` of transcripts in JSON lines, by file."""
    return tool_uses(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"))


def tool_uses(lines: DataFrame) -> DataFrame:
    """(file, tools, logged) of transcript lines (file, value): the tools that were used, in blocks of a message or of the line
    itself, and whether one of them logs a session. Lines that are no JSON objects are skipped."""
    lines = lines.select("file", F.try_parse_json("value").alias("line"))
    blocks = "array<variant>"
    inner = F.try_variant_get("line", "$.message.content", blocks)
    whole = F.try_variant_get("line", "$.message", "variant")
    found = F.coalesce(F.when(whole.isNotNull(), inner).otherwise(F.try_variant_get("line", "$.content", blocks)), F.array().cast(blocks))
    names = F.transform(F.filter(found, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_use", F.lit(False))), lambda b: F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("")))
    rows = lines.select("file", names.alias("names"))
    return rows.groupBy("file").agg(F.sum(F.size("names")).alias("tools"), F.bool_or(F.exists("names", lambda n: F.contains(n, F.lit("log_session")))).alias("logged"))


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    bad = "_bad"
    rows = spark.read.schema(f"{schema}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.filter(F.col(bad).isNull()).drop(bad)


def read_vectors(spark: SparkSession, path: str, prefix: str, model: str) -> DataFrame:
    """(path, vec, at) of vector files whose lines are ``"key": {...},``: the last entry of each key with ``prefix``; files
    with a malformed line are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    parsed = F.try_parse_json(F.concat(F.lit("{"), F.regexp_replace(F.trim("value"), ",$", ""), F.lit("}")))
    body = F.regexp_replace(F.regexp_replace(F.trim("value"), ",$", ""), r'^"(?:[^"\\]|\\.)*"\s*:', "")
    rows = lines.withColumn("ok", parsed.isNotNull()).withColumn("key", F.regexp_extract(F.trim("value"), r'^"((?:[^"\\]|\\.)*)"', 1))
    good = rows.groupBy("file").agg(F.bool_and("ok").alias("good")).filter("good").select("file")
    kept = rows.join(good, "file", "left_semi").filter(F.col("key").startswith(prefix))
    data = F.try_parse_json(body)
    kept = kept.select("key", "file", "line", F.try_variant_get(data, "$.path", "string").alias("path"), F.try_variant_get(data, f"$.embeddings['{model}'].vec", "array<double>").alias("vec"), F.coalesce(F.try_variant_get(data, "$.last_embed.at", "long"), F.lit(0)).alias("at"))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("file"), F.desc("line"))) == 1
    return kept.withColumn("_last", last).filter("_last").filter(F.col("path").isNotNull() & F.col("vec").isNotNull()).select("path", "vec", "at")


def fresh_vectors(vectors: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, vec, fresh) of ``read_vectors`` for notes that exist (path, mtime): fresh if made since the note's last change."""
    changed = F.unix_millis("mtime")
    return vectors.join(paths.select("path", "mtime"), "path").select("path", "vec", (F.col("at") >= changed).alias("fresh"))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``wanted`` (seq, stem) with name: the stem, or with the first of `` 2``, `` 3`` and so on behind it that neither a note
    nor an earlier row of the same stem has, whatever the case."""
    used = taken.select(F.lower(tx.stem(F.col("path"))).alias("_used")).distinct()
    behind = r"^(.*) ([2-9]|[1-9]\d+)$"
    numbers = used.select(F.col("_used").alias("_base"), F.lit(1).cast("long").alias("_n")).union(used.filter(F.col("_used").rlike(behind)).select(F.regexp_extract("_used", behind, 1), F.regexp_extract("_used", behind, 2).try_cast("long")))
    numbers = numbers.filter(F.col("_n").isNotNull()).groupBy("_base").agg(F.array_sort(F.collect_set("_n")).alias("_numbers"))  # of one stem
    rank = F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("seq")).cast("long")
    rows = wanted.withColumn("_rank", rank).join(numbers, F.lower("stem") == F.col("_base"), "left")
    at = F.coalesce(F.aggregate("_numbers", F.col("_rank"), lambda n, x: F.when(x <= n, n + 1).otherwise(n)), F.col("_rank"))
    return rows.select("seq", "stem", F.when(at == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" "), at.cast("string"))).alias("name"))


def write_table(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """State tables (manifest, vectors, journal): a full refresh, or rows added."""
    rows.write.mode("overwrite" if overwrite else "append").parquet(path)


def merge_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)
