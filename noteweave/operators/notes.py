"""Note queries: filters, links, tasks, recency."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import front
from noteweave.functions import text as tx


def with_tags(notes: DataFrame, tags: list[str]) -> DataFrame:
    """Notes whose front matter has all the tags, whatever their case; no tags: all notes."""
    if not tags:
        return notes
    have = F.transform(tx.front_list(F.col("text"), "tags"), lambda t: F.lower(t))
    return notes.filter(F.size(F.array_except(F.array(*[F.lit(t.lower()) for t in tags]), have)) == 0)


def in_folder(notes: DataFrame, folder: str) -> DataFrame:
    return notes.filter(F.col("path").startswith(folder.rstrip("/") + "/"))


def query_notes(notes: DataFrame, tags: list[str] | None = None, project: str | None = None, folder: str | None = None) -> DataFrame:
    """Notes by tags, project and folder; without any, those with front matter."""
    if not tags and project is None and folder is None:
        return notes.filter(F.size(F.json_object_keys(F.to_json(front.meta(F.col("text"))))) > 0)
    if folder is not None:
        notes = in_folder(notes, folder)
    if tags:
        notes = with_tags(notes, tags)
    if project is not None:
        found = front.meta(F.col("text"))
        given = F.try_variant_get(found, "$.project", "variant")
        name = F.when(F.schema_of_variant(given) == "VOID", "none").otherwise(F.lower(F.coalesce(front.value(found, "project"), F.lit(""))))  # null is spelt out
        notes = notes.filter(name == project.lower())
    return notes


def title_search(notes: DataFrame, words: str, limit: int) -> DataFrame:
    hit = F.contains(F.lower(tx.stem(F.col("path"))), F.lit(words.lower()))
    return notes.filter(hit).orderBy(tx.path_key(F.col("path"))).limit(limit)


def search_lines(notes: DataFrame, words: str, limit: int) -> DataFrame:
    """(path, line, number) of the first ``limit`` lines, by path and place, that hold ``words``; a note whose title does
    comes once before its lines, with ``(title match)`` as line 0."""
    wanted = F.lit(words.lower())
    title = F.when(F.contains(F.lower(tx.stem(F.col("path"))), wanted), F.array(F.struct(F.lit(0).alias("number"), F.lit("(title match)").alias("line")))).otherwise(F.array().cast("array<struct<number:int,line:string>>"))
    every = F.transform(tx.lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("number"), F.trim(x).alias("line")))
    hits = F.concat(title, F.filter(every, lambda x: F.contains(F.lower(x["line"]), wanted)))
    return notes.select("path", F.inline(hits)).orderBy(tx.path_key(F.col("path")), "number").limit(limit)


def backlinks(notes: DataFrame, target: str) -> DataFrame:
    """Other notes with a link to the target's stem, each once."""
    stem = target.rsplit("/", 1)[-1].removesuffix(".md").lower()
    return notes.filter((F.col("path") != target) & F.array_contains(tx.wikilinks(F.col("text")), stem))


def list_tasks(notes: DataFrame, open_only: bool = False) -> DataFrame:
    """(path, done, task) of every check-box line."""
    rows = notes.select("path", F.inline(tx.tasks(F.col("text"))))
    return rows.filter(~F.col("done")) if open_only else rows


def list_recent(notes: DataFrame, time: str, key: str, n: int) -> DataFrame:
    return notes.orderBy(F.desc(time), F.desc(key)).limit(n)


def since(rows: DataFrame, time: str, day: str) -> DataFrame:
    """Rows from the day ``YYYY-MM-DD`` on."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"since must be YYYY-MM-DD: {day!r}")
    return rows.filter(F.col(time) >= F.to_timestamp(F.lit(day), "yyyy-MM-dd"))


def since_days(rows: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last days before the latest one."""
    latest = rows.agg(F.max(time).alias("_latest"))
    return rows.join(F.broadcast(latest)).filter(F.col(time) >= F.col("_latest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_latest")


def duplicate_stems(notes: DataFrame) -> DataFrame:
    """(stem, n) of folded stems that several notes have."""
    return notes.groupBy(F.lower(tx.stem(F.col("path"))).alias("stem")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
