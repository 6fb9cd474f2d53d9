"""Retrieval quality: golden sets, success and recall at k, first relevant rank, reciprocal rank, and their history."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import front

GOLDEN = "id string, query string, expect array<string>, accept array<string>, tags array<string>, folder string, note string"


def golden(spark: SparkSession, text: str, markdown: bool = False) -> DataFrame:
    """A golden set (see GOLDEN) from a YAML list, in markdown the one in its first yaml fence. Each entry has an id of its
    own, a query and expected paths; ValueError says which one lacks what."""
    if markdown:
        fence = re.search(r"```yaml\s*\n(.*?)```", text, re.DOTALL)
        if fence is None:
            raise ValueError("no yaml fence in the golden set")
        text = fence[1]
    try:
        reader = front.Reader(text)
        entries = reader.node(0)
        if reader.peek() is not None:
            raise front.Malformed("text behind the list")
    except (front.Malformed, IndexError) as e:
        raise ValueError(f"the golden set is no YAML: {e}") from e
    if not isinstance(entries, list):
        raise ValueError("a golden set is a list")
    rows: dict[str, tuple] = {}
    for at, entry in enumerate(entries):
        named = {k: str(entry[k]).strip() for k in ("id", "query") if isinstance(entry, dict) and entry.get(k) is not None}
        if len(named) < 2 or not all(named.values()):
            raise ValueError(f"entry {at} needs an id and a query")
        paths = {}
        for k in ("expect", "accept", "tags"):
            value = entry.get(k)
            if isinstance(value, dict):
                raise ValueError(f"golden {entry['id']}: {k} is neither text nor a list")
            paths[k] = [] if value is None else [str(x) for x in value] if isinstance(value, list) else [str(value)]
        if str(entry["id"]) in rows:
            raise ValueError(f"duplicate golden id: {entry['id']}")
        if not paths["expect"]:
            raise ValueError(f"golden {entry['id']}: nothing is expected")
        rows[str(entry["id"])] = (str(entry["id"]), str(entry["query"]), paths["expect"], paths["accept"], paths["tags"], str(entry["folder"]) if entry.get("folder") else None, str(entry.get("note") or ""))
    return spark.createDataFrame(list(rows.values()), GOLDEN)


def judged_items(golden_: DataFrame, notes: DataFrame) -> DataFrame:
    """(query, item, expect, missing) of a golden set's expected and accepted paths; a path that leaves the vault, or that no
    note has, is missing."""
    each = lambda c, e: golden_.select(F.col("id").alias("query"), F.explode(c).alias("item"), F.lit(e).alias("expect"))
    items = each("expect", True).union(each("accept", False)).groupBy("query", "item").agg(F.max("expect").alias("expect"))
    outside = F.col("item").rlike(r"^([/\\\\]|[A-Za-z]:)|(^|[/\\\\])\.\.([/\\\\]|$)")
    found = notes.select(F.col("path").alias("item"), F.lit(True).alias("_there")).distinct()
    return items.join(found, "item", "left").select("query", "item", "expect", (outside | F.col("_there").isNull()).alias("missing"))


def require_present(items: DataFrame, most: int = 20) -> None:
    """ValueError that names some of the missing items, if there are any: the strict mode."""
    gone = items.filter("missing").orderBy("query", "item").limit(most).collect()
    if gone:
        raise ValueError("golden paths missing: " + "; ".join(f"{r.query}: {r['item']}" for r in gone))


def per_query(gold: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """gold (query, item, expect: else only accepted; missing, if items may be), hits (query, item, rank): recall counts
    expected items, success and first rank all; missing items count for nothing, and queries without an expected item are
    skipped."""
    if "missing" in gold.columns:
        gold = gold.filter(~F.col("missing"))
    judged = gold.join(hits.select("query", "item", "rank"), ["query", "item"], "left")
    out = judged.groupBy("query").agg(
        F.count_if("expect").alias("_expected"),
        F.count_if(F.col("expect") & (F.col("rank") <= k)).alias("_found"),
        F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("success"),
        F.min("rank").alias("first_rank"),
    )
    out = out.filter(F.col("_expected") > 0).withColumn("recall", F.col("_found") / F.col("_expected"))
    return out.withColumn("rr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).drop("_expected", "_found")


def summary(scored: DataFrame) -> DataFrame:
    """Means over the queries of ``per_query``."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("success").alias("success"), F.avg("rr").alias("mrr"))


def record(scored: DataFrame, when: str, version: str, vault: str, golden_path: str) -> str:
    """A line of the history of scorecards."""
    return json.dumps({"ts": when, "git": version, "vault": vault, "golden": golden_path, **summary(scored).first().asDict()})
