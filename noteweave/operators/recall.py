"""Recall: what changed since a day, and what is needed to take up a project again.

Notes are tables of path, text and mtime. Each part is a table of its own, so one that cannot be read leaves the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import front
from noteweave.functions import text as tx
from noteweave.operators import notes as nt

#: Where sessions, captures, entities and decisions are kept, how times are written, and a context's parts.
SESSIONS, INBOX, GRAPH, DECISIONS = "Claude/Sessions", "Claude/Inbox", "Claude/Graph", "Claude/Decisions.md"
MINUTE = "yyyy-MM-dd HH:mm"
MOST_SESSIONS, MOST_TASKS, MOST_DECISIONS, EXCERPT, BUDGET = 3, 5, 3, 300, 2000


def changed(notes: DataFrame, cutoff, folder: str | None = None) -> DataFrame:
    """(path, modified) of notes from the time ``cutoff`` on, by minute, latest first."""
    rows = notes if folder is None else nt.in_folder(notes, folder)
    return rows.filter(F.col("mtime") >= cutoff).select("path", F.date_format("mtime", MINUTE).alias("modified")).orderBy(F.desc("modified"), tx.path_key(F.col("path")))


def done_recently(notes: DataFrame, cutoff) -> DataFrame:
    """(path, done, task) of ticked tasks in notes that changed from ``cutoff`` on."""
    return nt.list_tasks(notes.filter(F.col("mtime") >= cutoff)).filter("done")


def sessions(notes: DataFrame, project: str, limit: int = 10) -> DataFrame:
    """(path, created, excerpt) of the latest sessions whose project or title holds ``project``; without a date of its own a
    note counts by its time of change."""
    rows = nt.in_folder(notes, SESSIONS).withColumn("_meta", front.meta(F.col("text")))
    hay = F.lower(F.concat_ws(" ", F.coalesce(front.value(F.col("_meta"), "project"), F.lit("")), tx.stem(F.col("path"))))
    created = F.coalesce(F.nullif(front.value(F.col("_meta"), "created"), F.lit("")), F.date_format("mtime", MINUTE))
    rows = rows.filter(F.contains(hay, F.lit(project.lower()))).select("path", created.alias("created"), tx.body_excerpt(F.col("text")).alias("excerpt"))
    return rows.orderBy(F.desc("created"), tx.path_key(F.col("path"))).limit(limit)


def decisions(notes: DataFrame, project: str) -> DataFrame:
    """(number, line) of the decisions' list lines that hold ``project``."""
    rows = notes.filter(F.col("path") == DECISIONS).select(F.posexplode(tx.lines(F.col("text"))).alias("number", "line"))
    return rows.filter(F.col("line").startswith("- ") & F.contains(F.lower("line"), F.lit(project.lower()))).orderBy("number")


def open_tasks(notes: DataFrame, project: str) -> DataFrame:
    """(path, task) of open tasks that hold ``project``, by path and place."""
    rows = notes.select("path", F.posexplode(tx.tasks(F.col("text"))).alias("number", "t")).select("path", "number", "t.*")
    return rows.filter(~F.col("done") & F.contains(F.lower("task"), F.lit(project.lower()))).orderBy(tx.path_key(F.col("path")), "number").select("path", "task")


def digest(notes: DataFrame, cutoff) -> dict[str, DataFrame]:
    """The parts of a digest by name."""
    return {
        "recent_notes": changed(notes, cutoff), "inbox_captures": changed(notes, cutoff, INBOX), "new_entities": changed(notes, cutoff, GRAPH),
        "open_tasks": nt.list_tasks(notes, open_only=True), "done_recently": done_recently(notes, cutoff),
    }


def resume(notes: DataFrame, project: str, entities: DataFrame | None = None, limit: int = 10) -> dict[str, DataFrame]:
    """The parts of taking up a project again, by name; entities (name, aliases, ...) if there is a graph."""
    parts = {"sessions": sessions(notes, project, limit), "decisions": decisions(notes, project), "tasks": open_tasks(notes, project)}
    if entities is not None:
        parts["entities"] = entities.filter(F.exists(F.concat(F.array("name"), "aliases"), lambda x: F.contains(F.lower(x), F.lit(project.lower()))))
    return parts


def context_lines(notes: DataFrame, project: str) -> DataFrame:
    """(part, number, line): the latest sessions, open tasks and decisions, a few each."""
    title = F.concat(F.lit("Session: "), tx.stem(F.col("path")), F.lit(" — "), F.substring("excerpt", 1, EXCERPT))
    last = sessions(notes, project, MOST_SESSIONS).agg(F.array_sort(F.collect_list(F.struct(F.col("created"), F.col("path"), title.alias("line"))), lambda a, b: F.when(a["created"] > b["created"], -1).when(a["created"] < b["created"], 1).when(tx.path_key(a["path"]) < tx.path_key(b["path"]), -1).otherwise(1)).alias("xs"))
    last = last.select(F.lit(0).alias("part"), F.posexplode(F.transform("xs", lambda x: x["line"])).alias("number", "line"))
    tasks = open_tasks(notes, project).limit(MOST_TASKS).agg(F.collect_list(F.struct("path", "task")).alias("xs")).select(F.lit(1).alias("part"), F.posexplode(F.transform("xs", lambda x: F.concat(F.lit("Open task: "), x["task"]))).alias("number", "line"))
    made = decisions(notes, project).limit(MOST_DECISIONS).select(F.lit(2).alias("part"), "number", "line")
    return last.union(tasks).union(made)


def context_block(notes: DataFrame, project: str | None, budget: int = BUDGET) -> str:
    """The context as text of at most ``budget`` characters, cut at a line's end where there is one."""
    if not project:
        return ""
    text = "\n".join(r.line for r in context_lines(notes, project).orderBy("part", "number").collect())  # a few lines
    if len(text) <= budget:
        return text
    whole = text[:budget].rpartition("\n")[0]
    return whole or text[:budget]
