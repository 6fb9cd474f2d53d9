"""Consolidation of near-duplicate entities: vectors, blocking, packed batches, a verdict for each, and the merged graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import blocking, graph, plug


def identities(entities: DataFrame) -> DataFrame:
    """(path, hash, text) of entities (path, name, aliases, summary): the text that stands for each."""
    text = tx.identity(F.col("name"), F.col("aliases"), F.coalesce("summary", F.lit("")))
    return entities.select("path", text.alias("text")).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).select("path", "hash", "text")


def vectors(entities: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(path, hash, vec): cached vectors (path, hash, vec) of unchanged entities, and new ones of the rest. Of a cache that
    repeats a path and hash one entry counts."""
    ids = identities(entities)
    once = cache.groupBy("path", "hash").agg(F.min("vec").alias("vec"))
    none = ids.limit(0).select("path", F.array().cast("array<double>").alias("vec"), F.lit(False).alias("fresh"))
    return plug.current_vectors(ids, none, once, embed).join(ids.select("path", "hash"), "path").select("path", "hash", "vec")


def checked(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, checked): whether an entity was looked at (seen: path, hash) as it is now."""
    ids = identities(entities)
    return ids.join(seen.select("path", F.col("hash").alias("_old")), "path", "left").select("path", F.coalesce(F.col("hash") == F.col("_old"), F.lit(False)).alias("checked"))


def batches(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(batch, cluster, type, name, aliases) of the entities that ``pairs`` (a, b) connect: clusters are components, cut in
    even chunks, and packed whole into batches in the order of their least paths."""
    found = graph.components(pairs).select(F.col("node").alias("path"), "component")
    chunks = blocking.balanced_chunks(found, "component")
    sizes = chunks.groupBy("component", "chunk").agg(F.count(F.lit(1)).alias("size"), F.min("path").alias("first")).withColumn("seq", F.struct("component", "chunk"))
    packed = blocking.pack_batches(sizes.select("seq", "size")).select("seq.*", "batch")
    rows = chunks.join(packed, ["component", "chunk"]).join(entities.select("path", "type", "name", "aliases"), "path")
    return rows.select("batch", F.concat_ws("#", "component", "chunk").alias("cluster"), "type", "name", "aliases")


def propose(entities: DataFrame, pairs: DataFrame, judge: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(merges, skipped): valid merges (type, canonical, duplicates) by name, and (batch, error) of batches without a verdict."""
    answers = plug.adjudicate_batches(batches(entities, pairs), judge)
    return plug.valid_merges(answers, entities), answers.filter(F.col("error").isNotNull()).select("batch", "error")


def as_paths(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """(dup, canonical) by path, of merges by name; a duplicate goes to the first of several, and none to itself."""
    named = entities.select(F.lower("type").alias("type"), F.lower("name").alias("name"), "path").groupBy("type", "name").agg(F.min("path").alias("path"))
    each = merges.select("type", F.lower("canonical").alias("canonical"), F.explode("duplicates").alias("dup")).withColumn("dup", F.lower("dup"))
    met = each.join(named.withColumnsRenamed({"name": "canonical", "path": "_to"}), ["type", "canonical"]).join(named.withColumnsRenamed({"name": "dup", "path": "_from"}), ["type", "dup"])
    return met.filter(F.col("_from") != F.col("_to")).groupBy(F.col("_from").alias("dup")).agg(F.min("_to").alias("canonical"))


def run(entities: DataFrame, mentions: DataFrame, edges: DataFrame, pairs: DataFrame, judge: Callable[[str], str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, edges) after the merges that ``judge`` finds among ``pairs``, and redirects (path, next) from what
    was merged."""
    merges, _ = propose(entities, pairs, judge)
    paths = as_paths(merges, entities)
    ends = graph.resolve_redirects(entities.select("path").join(paths.select(F.col("dup").alias("path"), F.col("canonical").alias("next")), "path", "left").withColumn("gone", F.lit(False)))
    final = paths.select(F.col("dup").alias("path")).join(ends, "path").filter(F.col("target").isNotNull()).select(F.col("path").alias("dup"), F.col("target").alias("canonical"))
    return *graph.merge_entities(entities, mentions, edges, final), final.select(F.col("dup").alias("path"), F.col("canonical").alias("next"))
