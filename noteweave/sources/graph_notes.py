"""The entity graph kept as notes: one note for each entity, with sections for mentions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import front
from noteweave.functions import text as tx

#: The graph's place in a vault, and folders and files that are not filed.
GRAPH = "Claude/Graph/"
FOLDERS = {"person": "People", "organization": "Organizations", "domain": "Domains", "topic": "Topics", "project": "Projects", "source": "Sources"}
NOT_TAXONOMY = ("Claude", "00 - Maps of Content", ".obsidian", ".smart-env", ".trash", ".space", "copilot")
NOT_FILED = ("CLAUDE.md", "AGENTS.md", "README.md")


def _entity_notes(notes: DataFrame) -> DataFrame:
    text = F.col("text")
    rows = notes.filter(F.col("path").startswith(GRAPH)).withColumn("entity", F.regexp_replace("path", r"\.md$", ""))
    return rows.withColumns({"merged_into": F.nullif(F.trim(tx.front_value(text, "merged_into")), F.lit("")), "retired": F.nullif(F.trim(tx.front_value(text, "retired")), F.lit(""))})


def rebuild(notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, edges) of the live entity notes among ``notes`` (path, text)."""
    live = _entity_notes(notes).filter(F.col("merged_into").isNull() & F.col("retired").isNull())
    text, kind = F.col("text"), F.trim(tx.front_value(F.col("text"), "entity"))
    after = F.substr(tx.body(text), F.greatest(F.locate("\n# ", tx.body(text)), F.lit(1)) + 1)
    first = F.get(F.filter(F.transform(tx.lines(after), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), 0)
    entities = live.select(F.col("entity").alias("path"), tx.heading(text, F.col("path")).alias("name"), F.when(kind == "", "topic").otherwise(kind).alias("type"), F.coalesce(first, F.lit("")).alias("summary"), tx.front_list(text, "aliases").alias("aliases"))
    lines = live.select("entity", F.explode(tx.section_lines(text, "## Mentions")).alias("line")).withColumn("m", tx.mention_line(F.col("line")))
    mentions = lines.filter(F.col("m.target") != "").select("entity", F.col("m.target").alias("note"), F.col("m.evidence").alias("evidence"))
    lines = live.select("entity", F.explode(tx.section_lines(text, "## Relations")).alias("line")).withColumn("r", tx.relation_line(F.col("line")))
    edges = lines.filter(F.col("r.target") != "").select(F.col("entity").alias("src"), "r.rel", F.col("r.target").alias("dst"))
    return entities, mentions, edges


def redirects(notes: DataFrame) -> DataFrame:
    """(path, next, gone) of all entity notes."""
    return _entity_notes(notes).select(F.col("entity").alias("path"), F.col("merged_into").alias("next"), F.col("retired").isNotNull().alias("gone"))


def taxonomy(notes: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(folder): top folders that notes are filed in, empty ones of ``folders`` (path) among them; folders that hold a
    sheet's schema are none."""
    top = notes.filter(F.contains("path", F.lit("/"))).select(tx.top_folder(F.col("path")).alias("folder"))
    if folders is not None:
        top = top.union(folders.select(tx.top_folder(F.col("path"))))
    sheet = notes.filter(F.col("path").rlike(r"^[^/]+/_schema\.md$")).select(tx.top_folder(F.col("path")).alias("folder"))
    top = top.distinct().join(sheet, "folder", "left_anti")
    return top.filter(~F.col("folder").isin(*NOT_TAXONOMY) & ~F.col("folder").startswith("."))


def organized(notes: DataFrame) -> DataFrame:
    """Notes below the taxonomy's folders."""
    folders = taxonomy(notes).withColumnRenamed("folder", "_top")
    return notes.join(folders, tx.top_folder(F.col("path")) == F.col("_top"), "left_semi")


def filing_candidates(notes: DataFrame) -> DataFrame:
    """Notes at the root, then those in the taxonomy, by path, that do not ask to be left alone and are no rows of a sheet."""
    root = notes.filter(~F.contains("path", F.lit("/")) & ~F.col("path").isin(*NOT_FILED)).withColumn("_filed", F.lit(1))
    rows = root.unionByName(organized(notes).withColumn("_filed", F.lit(2)))
    parent = F.regexp_replace(F.col("path"), r"/[^/]*$", "")
    sheets = notes.filter(F.col("path").endswith("/_schema.md")).select(parent.alias("_parent")).distinct()
    kept = rows.withColumn("_parent", parent).join(sheets, "_parent", "left_anti").filter(~front.is_false(front.meta(F.col("text")), "organize"))
    return kept.orderBy("_filed", tx.path_key(F.col("path"))).select(*notes.columns)


def gather(notes: DataFrame) -> DataFrame:
    """(path, name, type, aliases, summary) of the live entity notes, named by their files."""
    live = _entity_notes(notes).filter(F.col("merged_into").isNull() & F.col("retired").isNull())
    kind = tx.front_value(F.col("text"), "entity")
    return live.select(F.col("entity").alias("path"), tx.stem(F.col("path")).alias("name"), F.when(kind == "", "topic").otherwise(kind).alias("type"), tx.front_list(F.col("text"), "aliases").alias("aliases"), tx.entity_summary(F.col("text")).alias("summary"))


def entity_note(name: str, kind: str, aliases: list[str], summary: str) -> str:
    """The text of a new entity note."""
    return front.write({"entity": kind, "aliases": aliases}) + f"# {name}\n\n{summary}\n\n## Mentions\n\n## Relations\n"


def tombstone(text: str, day: str) -> str:
    """A note retired on a day: its aliases and summary stay."""
    return front.patch(text, {"retired": day})


def upsert_entities(entities: DataFrame, found: DataFrame) -> DataFrame:
    """(path, name, type, aliases, summary, action) after ``found`` (name, type, aliases, summary, each name and type once)
    meets the entity notes (path, name, type, aliases, summary, next, gone): matched by name, name as a file or alias within
    a type. A redirect's live end takes the aliases; what is retired is revived with its old ones; the rest is created."""
    from noteweave.operators.graph import resolve_redirects

    ends = resolve_redirects(entities.select("path", "next", "gone"))
    keys = entities.select("path", "type", F.explode(F.transform(F.concat(F.array("name"), "aliases"), lambda a: F.lower(a))).alias("_key")).groupBy("type", "_key").agg(F.min("path").alias("_at"))
    rows = found.withColumn("_keys", F.array_distinct(F.array(F.lower("name"), F.lower(tx.safe_name(F.col("name"))))))
    met = rows.select("name", "type", F.explode("_keys").alias("_key")).join(keys, ["type", "_key"]).groupBy("name", "type").agg(F.min("_at").alias("_at"))
    met = met.join(ends.select(F.col("path").alias("_at"), "target"), "_at", "left").withColumn("path", F.coalesce("target", "_at")).drop("_at", "target")
    rows = rows.join(met, ["name", "type"], "left").drop("_keys")
    new = rows.filter(F.col("path").isNull()).select(F.concat(F.lit(GRAPH), F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("type")), F.lit("/"), tx.safe_name(F.col("name"))).alias("path"), "name", "type", "aliases", "summary", F.lit("created").alias("action"))
    known = rows.filter(F.col("path").isNotNull()).groupBy("path").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.concat(F.array("name"), "aliases"))))).alias("_more"), F.min_by("summary", "name").alias("_summary"))
    have = F.transform(F.concat(F.array("name"), "aliases"), lambda h: F.lower(h))
    joined = entities.join(known, "path", "left").withColumn("_have", have)
    joined = joined.withColumn("_extra", F.filter("_more", lambda m: ~F.array_contains("_have", F.lower(m))))
    revived = F.col("gone") & F.col("_more").isNotNull()
    done = joined.select(
        "path", "name", "type", F.when(F.col("_more").isNull(), F.col("aliases")).otherwise(F.concat("aliases", "_extra")).alias("aliases"), F.when(revived, F.coalesce(F.nullif("_summary", F.lit("")), F.col("summary"))).otherwise(F.col("summary")).alias("summary"),
        F.when(revived, F.lit("revived")).when(F.coalesce(F.size("_extra"), F.lit(0)) > 0, F.lit("extended")).otherwise(F.lit("kept")).alias("action"),
    )
    return done.unionByName(new)
