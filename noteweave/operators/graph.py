"""The entity graph: look-ups, traversal, redirects, components, clean-up and merging.

Tables: entities (path, name, type, aliases), mentions (entity, note), edges (src, rel, dst), redirects (path, next: null
when live, gone: boolean).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.operators.storage import written

MAX_REDIRECTS = 5


def find_entity(entities: DataFrame, mentions: DataFrame, edges: DataFrame, words: str) -> DataFrame:
    """Entities whose name or an alias holds ``words``, with mention_count (rows) and sorted relations."""
    wanted = F.lit(words.lower())
    found = entities.filter(F.exists(F.concat(F.array("name"), "aliases"), lambda x: F.contains(F.lower(x), wanted)))
    counts = mentions.join(found.select(F.col("path").alias("entity")), "entity", "left_semi").groupBy(F.col("entity").alias("path")).agg(F.count(F.lit(1)).alias("mention_count"))
    out = edges.join(found.select(F.col("path").alias("src")), "src", "left_semi")
    names = entities.select(F.col("path").alias("dst"), F.col("name").alias("_name"))
    short = F.regexp_replace(F.element_at(F.split("dst", "/"), -1), r"(?<=.)\.[^.]+$", "")
    relations = out.join(names, "dst", "left").groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "rel", F.coalesce("_name", short)))).alias("relations"))
    joined = found.join(counts, "path", "left").join(relations, "path", "left")
    return joined.withColumn("mention_count", F.coalesce("mention_count", F.lit(0))).withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))


def note_entities(mentions: DataFrame, note: str) -> DataFrame:
    return mentions.filter(F.col("note") == note).select("entity").distinct()


def related_notes(mentions: DataFrame, edges: DataFrame, note: str, hops: int = 2) -> DataFrame:
    """(note, depth, via): notes that mention an entity within ``hops`` - 1 edges of the note's own, by the first chain
    that reaches them (fewest edges, then entity names in order)."""
    seed = mentions.sparkSession.createDataFrame([(note,)], "seed string")
    return related_of(mentions, edges, seed, hops).drop("seed")


def related_of(mentions: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, note, depth, via): as ``related_notes`` for each of a few notes ``seeds`` (seed)."""
    own = mentions.join(F.broadcast(seeds), mentions["note"] == seeds["seed"]).select("seed", "entity").distinct()
    reached = own.select("seed", "entity", F.lit(0).alias("depth"), F.col("entity").alias("via"))
    both = edges.select("src", "rel", "dst").union(edges.select("dst", "rel", "src")).distinct()
    frontier = reached
    for depth in range(1, max(0, hops - 1) + 1):
        step = frontier.join(both.withColumnRenamed("src", "entity"), "entity").select("seed", F.col("dst").alias("entity"), F.lit(depth).alias("depth"), F.concat("via", F.lit(" ("), "rel", F.lit(") "), "dst").alias("via"))
        step = step.join(reached.select("seed", "entity"), ["seed", "entity"], "left_anti").groupBy("seed", "entity").agg(F.min("depth").alias("depth"), F.min("via").alias("via"))
        frontier = written(step, "frontier")
        reached = written(reached.union(frontier), "reached")
    hits = mentions.join(reached, "entity").filter(F.col("note") != F.col("seed"))
    return hits.groupBy("seed", "note").agg(F.min(F.struct("depth", "via")).alias("_first")).select("seed", "note", "_first.depth", "_first.via")


def context_bundle(hits: DataFrame, mentions: DataFrame, edges: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of a search's ``hits`` (path, rank): (entity, first_hit, hits) of the entities they mention, and (note, first_hit,
    depth, via) of the notes related to them, each by the first hit that leads to it."""
    hits = written(hits.select(F.col("path").alias("note"), "rank"), "hits")
    entities = mentions.join(F.broadcast(hits), "note").groupBy("entity").agg(F.min("rank").alias("first_hit"), F.count_distinct("note").alias("hits"))
    found = related_of(mentions, edges, hits.select(F.col("note").alias("seed")), hops).join(F.broadcast(hits.withColumnsRenamed({"note": "seed", "rank": "first_hit"})), "seed")
    first = found.groupBy("note").agg(F.min(F.struct("first_hit", "depth", "via")).alias("_first"))
    return entities, first.select("note", "_first.first_hit", "_first.depth", "_first.via")


def graph_stats(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): entities by type, and all edges and mentions."""
    count = F.count(F.lit(1)).alias("n")
    return entities.groupBy(F.concat(F.lit("type:"), "type").alias("kind")).agg(count).union(edges.agg(count).select(F.lit("edges"), "n")).union(mentions.agg(count).select(F.lit("mentions"), "n"))


def resolve_redirects(redirects: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """(path, target): the live entity that each path's redirects lead to; null if missing, gone, cyclic or too far."""
    links = redirects.select(F.col("path").alias("_at"), F.col("next").alias("_next"), F.col("gone").alias("_gone"))
    out = redirects.select("path", F.col("path").alias("_at"))
    for _ in range(most):
        step = out.join(links, "_at", "left")
        out = step.select("path", F.coalesce("_next", "_at").alias("_at"))
    last = out.join(links, "_at", "left")
    live = F.col("_next").isNull() & (F.col("_gone") == F.lit(False))
    return last.select("path", F.when(live, F.col("_at")).alias("target"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of pairs (a, b): the least node each reaches, by least labels and pointer jumps."""
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = labels.join(near, "node").select("node", F.least("component", "m").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("m"))
        new = written(new.join(far, "component", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").filter(F.col("component") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            return labels


def repair_relations(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, rel, dst, action): relations as they should be: kept, retargeted to the live entity, or removed (no live
    target, or one that the source has already). ``resolved``: (path, target); sources that are not live are skipped."""
    live = resolved.filter(F.col("path") == F.col("target")).select(F.col("path").alias("src"))
    rows = edges.join(live, "src", "left_semi").join(resolved.withColumnsRenamed({"path": "dst", "target": "_to"}), "dst", "left")
    kept = rows.filter(F.col("_to") == F.col("dst")).select("src", "rel", F.col("_to"))
    moved = rows.filter(F.col("_to") != F.col("dst"))
    again = moved.join(kept, ["src", "rel", "_to"], "left_semi").withColumn("action", F.lit("removed"))
    first = F.row_number().over(Window.partitionBy("src", "rel", "_to").orderBy("dst")) == 1
    new = moved.join(kept, ["src", "rel", "_to"], "left_anti").withColumn("action", F.when(first, "retargeted").otherwise("removed"))
    gone = rows.filter(F.col("_to").isNull()).withColumn("action", F.lit("removed"))
    same = rows.filter(F.col("_to") == F.col("dst")).withColumn("action", F.lit("kept"))
    every = same.unionByName(again).unionByName(new).unionByName(gone)
    return every.select("src", "rel", "dst", F.when(F.col("action") != "removed", F.col("_to")).alias("new_dst"), "action")


def first_fixes(repaired: DataFrame, most: int = 200) -> DataFrame:
    """``repair_relations`` with its first ``most`` changes by source, relation and target; the others are left for ``later``."""
    todo = repaired.filter("action <> 'kept'").orderBy("src", "rel", "dst").limit(most).select("src", "rel", "dst", F.lit(True).alias("_now"))
    rows = repaired.join(F.broadcast(todo), ["src", "rel", "dst"], "left")
    later = (F.col("action") != "kept") & F.col("_now").isNull()
    return rows.select("src", "rel", "dst", F.when(later, F.col("dst")).otherwise(F.col("new_dst")).alias("new_dst"), F.when(later, F.lit("later")).otherwise(F.col("action")).alias("action"))


def flatten_redirects(redirects: DataFrame) -> DataFrame:
    """(path, action, target): redirects of more than one step pointed at their end; dead ends to be retired."""
    stubs = redirects.filter(F.col("next").isNotNull()).select("path", "next")
    ends = stubs.join(resolve_redirects(redirects), "path")
    return ends.withColumn("action", F.when(F.col("target").isNull(), "retire").when(F.col("target") != F.col("next"), "flatten").otherwise("keep")).select("path", "action", "target")


def orphans(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities without a mention or a relation of their own that no relation points at."""
    used = mentions.select(F.col("entity").alias("path")).union(edges.select("src")).union(edges.select("dst")).distinct()
    return entities.join(used, "path", "left_anti")


def retirements(entities: DataFrame, mentions: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(path) of the entities to be retired now: those that are orphans still, of ``wanted`` (path) if it is given."""
    found = orphans(entities, mentions, edges).select("path")
    return found if wanted is None else found.join(wanted.select("path").distinct(), "path", "left_semi")


def orphaned_mentions(mentions: DataFrame, notes: DataFrame) -> DataFrame:
    return mentions.join(notes.select(F.col("path").alias("note")), "note", "left_anti")


def gone_notes(hashes: DataFrame, failures: DataFrame, current: DataFrame) -> DataFrame:
    """(path) of notes that the manifest has, by hash or by failure, and that are no more."""
    return hashes.select("path").union(failures.select("path")).distinct().join(current.select("path"), "path", "left_anti")


def retract_deleted(mentions: DataFrame, hashes: DataFrame, failures: DataFrame, current: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mentions, hashes, failures) without those of the first ``most`` notes that are gone, and one row of counts:
    retracted_notes, removed_mentions, remaining."""
    gone = gone_notes(hashes, failures, current)
    todo = F.broadcast(written(gone.orderBy("path").limit(most), "gone"))
    removed = mentions.join(todo.withColumnRenamed("path", "note"), "note", "left_semi").agg(F.count(F.lit(1)).alias("removed_mentions"))
    n = gone.agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("retracted_notes"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("remaining"))
    left = [t.join(todo if c == "path" else todo.withColumnRenamed("path", c), c, "left_anti") for t, c in ((mentions, "note"), (hashes, "path"), (failures, "path"))]
    return *left, n.join(F.broadcast(removed)).select("retracted_notes", "removed_mentions", "remaining")


def merge_entities(entities: DataFrame, mentions: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold duplicates into canonical entities (merges: dup, canonical): aliases take in the duplicates' names and
    aliases, mentions and relations move and are kept once."""
    canon = lambda c: F.coalesce(F.col("canonical"), F.col(c))
    named = entities.join(merges, entities["path"] == merges["dup"], "left")
    dups = named.filter(F.col("canonical").isNotNull()).select(F.col("canonical").alias("path"), F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    extra = dups.groupBy("path").agg(F.array_sort(F.collect_set("alias")).alias("_more"))
    kept = named.filter(F.col("canonical").isNull()).select(*entities.columns).join(extra, "path", "left")
    kept = kept.withColumn("aliases", F.array_sort(F.array_distinct(F.concat("aliases", F.coalesce("_more", F.array().cast("array<string>")))))).drop("_more")
    moved = mentions.join(merges, mentions["entity"] == merges["dup"], "left").select(canon("entity").alias("entity"), "note").distinct()
    out = edges.join(merges, edges["src"] == merges["dup"], "left").select(canon("src").alias("src"), "rel", "dst")
    return kept, moved, out.join(merges, out["dst"] == merges["dup"], "left").select("src", "rel", canon("dst").alias("dst")).filter(F.col("src") != F.col("dst")).distinct()
