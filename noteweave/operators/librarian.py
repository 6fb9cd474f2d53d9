"""A maintenance sweep over a vault's tables: index, file, clean up, consolidate, check. Each step replaces the tables it
changes by written ones; one that fails leaves them as they were, and the others run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import blocking, consolidate, graph, health, index, organize, plug, sheets, sweep
from noteweave.operators.storage import written


@dataclass(frozen=True)
class Tables:
    """notes (path, text); manifest (path, hash) and failures (path, error, attempts); the graph: entities (path, name, type,
    aliases, summary), mentions, edges and redirects (path, next, gone); vectors of notes (path, vec) and of entities
    (path, hash, vec); seen (path, hash) of entities that were looked at."""

    notes: DataFrame
    manifest: DataFrame
    failures: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    redirects: DataFrame
    vectors: DataFrame
    entity_vectors: DataFrame
    seen: DataFrame


def index_step(t: Tables, model: Callable[[str], str], batch: int = index.BATCH) -> tuple[Tables, DataFrame]:
    """Extract the next batch of notes that are due; one row of counts, with what remains and what is given up."""
    current = index.hashes(t.notes)
    todo, rest = index.next_batch(index.pending(current, t.manifest, t.failures), batch)
    todo = written(todo, "todo")
    done = written(plug.extract(t.notes.join(todo, "path", "left_semi"), model), "extracted")
    new = tuple(written(x, "new") for x in plug.apply_extraction(t.entities, done))
    manifest, failures = index.after_batch(current, t.manifest, t.failures, done.select("path", "error"))
    made = new[0].select(F.concat(F.lit("new/"), tx.safe_name(F.col("name"))).alias("path"), "name", "type", F.array().cast("array<string>").alias("aliases"), F.lit("").alias("summary"))
    counts = plug.index_counts(t.entities, t.mentions, t.edges, done, new).join(F.broadcast(rest)).join(F.broadcast(index.skipped(current, t.failures).agg(F.count(F.lit(1)).alias("skipped"))))
    after = replace(
        t, manifest=written(manifest, "manifest"), failures=written(failures, "failures"), entities=written(t.entities.unionByName(made), "entities"),
        mentions=written(plug.replace_mentions(t.mentions, done, new[1]), "mentions"), edges=written(t.edges.select("src", "rel", "dst").union(new[2]).distinct(), "edges"),
    )
    return after, written(counts, "counts")


def organize_step(t: Tables, candidates: DataFrame, apply: bool) -> tuple[Tables, DataFrame, DataFrame]:
    """Decide on ``candidates`` (path, current) by the vote of filed notes, and move those that are clear if ``apply``."""
    filed = t.vectors.join(t.notes.select("path"), "path", "left_semi").withColumn("folder", tx.top_folder(F.col("path"))).filter(F.contains("path", F.lit("/")))
    wanted = candidates.withColumn("stem", F.lower(tx.stem(F.col("path"))))
    stems = t.notes.groupBy(F.lower(tx.stem(F.col("path"))).alias("stem")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("stem")
    votes = organize.folder_vote(t.vectors.join(candidates.select("path"), "path", "left_semi"), filed)
    decided = written(organize.decisions(wanted, votes, stems).withColumn("share", F.bround("share", 3)), "decisions")
    moves = written(decided.filter("action = 'move'").select(F.col("path").alias("source"), F.concat_ws("/", "folder", F.element_at(F.split("path", "/"), -1)).alias("to")), "moves")
    if not apply or moves.isEmpty():
        return t, decided, moves
    notes, _ = organize.apply_moves(t.notes, moves)
    moved = {"manifest": t.manifest, "failures": t.failures, "vectors": t.vectors}
    return replace(t, notes=written(notes, "notes"), **{k: written(organize.transfer(v, moves), k) for k, v in moved.items()}), decided, moves


def cleanup_step(t: Tables) -> tuple[Tables, DataFrame]:
    """Retract what is gone, point relations at what lives, prune vectors; one row of counts."""
    mentions, manifest, failures, counts = graph.retract_deleted(t.mentions, t.manifest, t.failures, t.notes)
    repaired = written(graph.first_fixes(graph.repair_relations(t.edges, graph.resolve_redirects(t.redirects))), "repaired")
    live, gone = index.pruned(t.vectors, t.notes)
    actions = repaired.agg(F.count_if(F.col("action") == "retargeted").alias("retargeted"), F.count_if(F.col("action") == "removed").alias("removed"), F.count_if(F.col("action") == "later").alias("later"))
    after = replace(
        t, mentions=written(mentions, "mentions"), manifest=written(manifest, "manifest"), failures=written(failures, "failures"),
        edges=written(repaired.filter("new_dst IS NOT NULL").select("src", "rel", F.col("new_dst").alias("dst")).distinct(), "edges"), vectors=written(live, "vectors"),
    )
    return after, counts.join(F.broadcast(actions)).join(F.broadcast(gone))


def consolidate_step(t: Tables, embed: Callable, judge: Callable[[str], str], cursor: str | None, backstop: bool, threshold: float = blocking.SIMILARITY) -> tuple[Tables, DataFrame, str | None]:
    """Look at the next slice of entities and merge what is judged to be one; (tables, merges, the cursor)."""
    vectors = written(consolidate.vectors(t.entities, t.entity_vectors, embed), "entity-vectors")
    rows = consolidate.checked(t.entities, t.seen)
    part = written(blocking.select_slice(rows, cursor, backstop=backstop), "slice")
    typed = vectors.join(t.entities.select("path", F.col("type").alias("folder")), "path").select("path", "folder", "vec")
    pairs = written(blocking.knn_pairs(typed, part, threshold), "pairs")
    merges = written(consolidate.propose(t.entities, pairs, judge)[0], "merges")
    entities, mentions, edges, stubs = consolidate.run(t.entities, t.mentions, t.edges, pairs, judge)
    looked = consolidate.identities(t.entities).select("path", "hash").join(part, "path", "left_semi")
    kept = t.redirects.join(stubs.select("path"), "path", "left_anti").unionByName(stubs.withColumn("gone", F.lit(False)))
    after = replace(
        t, entities=written(entities, "entities"), mentions=written(mentions, "mentions"), edges=written(edges, "edges"), redirects=written(kept, "redirects"), entity_vectors=vectors,
        seen=written(t.seen.join(part, "path", "left_anti").unionByName(looked), "seen"),
    )
    return after, merges, blocking.next_cursor(rows, part, cursor)


def run_sweep(spark: SparkSession, t: Tables, model: Callable[[str], str], embed: Callable, judge: Callable[[str], str], candidates: DataFrame, apply: bool = True, cursor: str | None = None, backstop: bool = False, sheet_rows: dict[str, tuple[DataFrame, sheets.Sheet]] | None = None) -> tuple[Tables, list[sweep.Step], DataFrame, str | None]:
    """All steps in order, a report (metric, n, error) on the vault's health last; (tables, steps, report, cursor)."""
    at = {"t": t, "cursor": cursor, "decided": None, "merges": None}

    def index_() -> dict:
        def once() -> int:
            at["t"], counts = index_step(at["t"], model)
            at["counts"] = counts.first().asDict()
            return at["counts"]["remaining"]

        return {"rounds": index.drain(once), **at["counts"]}

    def organize_() -> DataFrame:
        at["t"], at["decided"], _ = organize_step(at["t"], candidates, apply)
        return at["decided"].agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("move", "propose", "skip")])

    def cleanup_() -> DataFrame:
        after, counts = cleanup_step(at["t"])
        at["t"] = after if apply else at["t"]
        return counts

    def consolidate_() -> DataFrame:
        after, at["merges"], cursor_ = consolidate_step(at["t"], embed, judge, at["cursor"], backstop)
        if apply:
            at["t"], at["cursor"] = after, cursor_
        return at["merges"].agg(F.count(F.lit(1)).alias("merges"))

    steps = sweep.run({"index": index_, "organize": organize_, "cleanup": cleanup_, "consolidate": consolidate_})
    now = at["t"]
    current = index.hashes(now.notes)
    none = spark.createDataFrame([], "canonical string")
    metrics = {
        "stale_embeddings": lambda: now.notes.join(now.vectors, "path", "left_anti"), "manifest_drift": lambda: index.drift(now.manifest, current).filter("state IN ('added', 'removed')"),
        "orphaned_entities": lambda: graph.orphaned_mentions(now.mentions.select("entity", "note").distinct(), now.notes), "cache_consistency": lambda: health.cache_faults(now.entities, now.redirects.filter("next IS NULL AND NOT gone").select("path").union(now.entities.select("path"))),
        "pending_proposals": lambda: health.pending_proposals(at["decided"], at["merges"].select("canonical") if not apply else none, none, True),
        "invalid_sheet_rows": lambda: _faulty(spark, sheet_rows or {}), "pending_retirements": lambda: graph.retirements(now.entities, now.mentions, now.edges), "sweep_errors": lambda: sweep.errors(spark, steps),
    }
    return now, steps, health.isolated(spark, metrics), at["cursor"]


def _faulty(spark: SparkSession, sheet_rows: dict[str, tuple[DataFrame, sheets.Sheet]]) -> DataFrame:
    out = spark.createDataFrame([], "path string, error string")
    for rows, sheet in sheet_rows.values():
        out = out.unionByName(sheets.check(rows, sheet))
    return out
