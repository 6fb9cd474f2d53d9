"""Incremental indexing: what is pending, drifted, stale or gone between a manifest and the current notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import text as tx

MAX_ATTEMPTS, BATCH, MOST_ROUNDS = 3, 25, 40


def hashes(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def drift(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): added, removed, changed or same."""
    m, c = manifest.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return m.join(c, "path", "full_outer").select("path", state.alias("state"))


def pending(current: DataFrame, manifest: DataFrame, failures: DataFrame, attempts: int = MAX_ATTEMPTS, force: bool = False) -> DataFrame:
    """Notes to index: new, changed or failed before, but not as often as ``attempts``."""
    rows = current.join(manifest.select("path", F.col("hash").alias("_old")), "path", "left").join(failures.select("path", "attempts"), "path", "left")
    if force:
        return rows.select("path")
    due = ~F.col("hash").eqNullSafe(F.col("_old")) | F.col("attempts").isNotNull()
    return rows.filter(due & (F.coalesce("attempts", F.lit(0)) < attempts)).select("path")


def stale_vectors(notes: DataFrame, plugin: DataFrame, cache: DataFrame) -> DataFrame:
    """Notes with neither a fresh vector nor a cached one of their hash."""
    fresh = plugin.filter("fresh").select("path")
    return notes.join(fresh, "path", "left_anti").join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def config_drift(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """(name, state): present, drifted, missing or extra."""
    w, i = wanted.select("name", F.col("value").alias("w"), F.lit(True).alias("_w")), installed.select("name", F.col("value").alias("i"), F.lit(True).alias("_i"))
    state = F.when(F.col("_i").isNull(), "missing").when(F.col("_w").isNull(), "extra").when(F.col("w").eqNullSafe(F.col("i")), "present").otherwise("drifted")
    return w.join(i, "name", "full_outer").select("name", state.alias("state"))


def next_batch(due: DataFrame, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """The first ``batch`` paths of ``due`` by path, and one row with how many remain."""
    return due.select("path").orderBy(tx.path_key(F.col("path"))).limit(batch), due.agg(F.greatest(F.count(F.lit(1)) - batch, F.lit(0)).alias("remaining"))


def skipped(current: DataFrame, failures: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Notes that failed too often to be tried again."""
    return current.select("path").join(failures.filter(F.col("attempts") >= attempts).select("path"), "path", "left_semi")


def preview(current: DataFrame, manifest: DataFrame, failures: DataFrame) -> DataFrame:
    """What a forced look would find due: new, changed or failed notes, however often they failed."""
    return pending(current, manifest, failures, attempts=1 << 30)


def after_batch(current: DataFrame, manifest: DataFrame, failures: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest and failures after a batch ``done`` (path, error): what succeeded has its hash and no failure any more, what
    failed one attempt more and its error, cut."""
    good = done.filter(F.col("error").isNull()).select("path")
    hashes_ = manifest.join(good, "path", "left_anti").select("path", "hash").unionByName(current.join(good, "path", "left_semi").select("path", "hash"))
    bad = done.filter(F.col("error").isNotNull()).join(failures.select("path", "attempts"), "path", "left")
    new = bad.select("path", F.substring("error", 1, 300).alias("error"), (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempts"))
    old = failures.join(done.select("path"), "path", "left_anti").select("path", "error", F.col("attempts").cast("int").alias("attempts"))
    return hashes_, old.unionByName(new)


def normal_failures(raw: DataFrame, caretakers: list[str]) -> DataFrame:
    """(path, error, attempts) of failures kept as JSON (path, value): a plain text is an error of one attempt; notes that the
    caretakers write are not tracked."""
    parsed = F.try_parse_json("value")
    error = F.coalesce(F.try_variant_get(parsed, "$.error", "string"), F.try_variant_get(parsed, "$", "string"), F.col("value"))
    rows = raw.filter(~F.col("path").isin(caretakers)) if caretakers else raw
    return rows.select("path", error.alias("error"), F.coalesce(F.try_variant_get(parsed, "$.attempts", "int"), F.lit(1)).alias("attempts"))


def drain(round_: Callable[[], int], most: int = MOST_ROUNDS) -> int:
    """Run ``round_`` until it says that nothing remains; the number of rounds. RuntimeError beyond ``most``."""
    for n in range(1, most + 1):
        if not round_():
            return n
    raise RuntimeError(f"still not done after {most} rounds")


def pruned(cache: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cache (path, ...) without entries of notes that are no more, and one row with how many went."""
    gone = cache.join(live.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("pruned"))
    return cache.join(live.select("path"), "path", "left_semi"), gone


def additive(installed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, values): what is installed with what is wanted behind it; nothing is taken away."""
    return installed.join(wanted.select("name", F.col("values").alias("_more")), "name", "full_outer").select("name", F.array_union(F.coalesce("values", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))).alias("values"))
