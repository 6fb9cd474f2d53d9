"""Typed record queries: filters, sorting, validation, duplicates and upserts; sheets kept as folders of notes.

Empty means null or ''. An empty value matches only ``ne``, ``nin`` and ``missing``. A sheet is a folder with a note
``_schema.md`` that names its columns, key and identity; its rows are the folder's other notes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import front
from noteweave.functions import text as tx

ORDERED = ("lt", "lte", "gt", "gte")

#: The schema's note, where no sheet may stand, the kinds of columns, and columns that every sheet has.
SCHEMA, NOT_SHEETS = "_schema.md", "Claude"
KINDS = ("string", "enum", "date", "bool", "url", "number")
STANDARD = ("created", "agent", "project", "tags")
DATE = r"^\d{4}-\d{2}-\d{2}$"
NUMBER = r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"
URL = r"^(?i:https?)://[^\s/?#]+\S*$"


@dataclass
class Field:
    kind: str = "string"  # one of KINDS
    required: bool = False
    values: tuple[str, ...] = ()
    max_length: int | None = None


@dataclass
class Sheet:
    fields: dict[str, Field]
    key: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()
    name: str = ""
    folder: str = ""
    filename: str = ""


def empty(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def compare(sheet: Sheet, name: str, op: str, value) -> Column:
    kind = sheet.fields[name].kind if name in sheet.fields else None
    if op in ORDERED and kind not in ("date", "number"):
        raise ValueError(f"{op} needs a date or number column: {name}")
    col = F.date_format(name, "yyyy-MM-dd") if kind == "date" else F.col(name)
    if op == "missing":
        return empty(name) == F.lit(bool(value))
    if op in ("in", "nin") and isinstance(value, str):
        raise ValueError(f"{op} needs a list: {name}")
    full = {
        "eq": lambda: col == value, "ne": lambda: col != value, "lt": lambda: col < value, "lte": lambda: col <= value, "gt": lambda: col > value, "gte": lambda: col >= value,
        "contains": lambda: F.contains(F.lower(col.cast("string")), F.lit(str(value).lower())), "in": lambda: col.isin(list(value)), "nin": lambda: ~col.isin(list(value)),
    }
    if op not in full:
        raise ValueError(f"unknown operator: {op}")
    return F.when(empty(name), F.lit(op in ("ne", "nin"))).otherwise(full[op]())


def query(rows: DataFrame, sheet: Sheet, filters: dict[str, dict], sort: str | None = None, descending: bool = False, tie: str = "path", limit: int | None = None) -> DataFrame:
    """Rows that meet every filter {column: {operator: value}}, sorted with empty values last."""
    tests = [compare(sheet, name, op, value) for name, ops in filters.items() for op, value in ops.items()]
    rows = rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows
    if sort:
        rows = rows.orderBy(empty(sort).cast("int"), F.col(sort).desc() if descending else F.col(sort).asc(), tie)
    return rows if limit is None else rows.limit(limit)


def first_error(sheet: Sheet, types: dict[str, str], required: bool = True, ignored: tuple[str, ...] = ("path",)) -> Column:
    """The first field at fault, in the columns' order, else an undeclared column that holds something, else the first
    required one that is absent; null if none. ``types``: the rows' columns by Spark's type; those of text hold numbers and
    truth values as front matter writes them. Null is absent, and at fault only where it is required."""
    errors = []
    for name, f in sheet.fields.items():
        if name not in types:
            continue
        col, kind = F.col(f"`{name}`"), types[name]
        text = col.cast("string")
        is_text, is_number = kind == "string", kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        wrong = {
            "enum": ~text.isin(list(f.values)) if f.values else F.lit(True),
            "date": ~text.rlike(DATE) if is_text else F.lit(kind != "date"),
            "number": ~text.rlike(NUMBER) if is_text else F.lit(not is_number),
            "bool": ~text.isin("true", "false") if is_text else F.lit(kind != "boolean"),
            "url": ~text.rlike(URL),
            "string": F.lit(not is_text),
        }[f.kind]
        errors.append(F.when(col.isNotNull() & wrong, F.lit(f"{name}: not a {f.kind}")))
        if f.max_length and f.kind in ("string", "url"):
            errors.append(F.when(F.length(text) > f.max_length, F.lit(f"{name}: longer than {f.max_length}")))
    known = {*sheet.fields, *STANDARD, *ignored}
    errors += [F.when(F.col(f"`{c}`").isNotNull(), F.lit(f"{c}: not declared")) for c in types if c not in known]
    if required:
        errors += [F.when(F.col(f"`{n}`").isNull() if n in types else F.lit(True), F.lit(f"{n}: missing")) for n, f in sheet.fields.items() if f.required]
    return F.coalesce(*errors, F.lit(None).cast("string"))


def check(rows: DataFrame, sheet: Sheet) -> DataFrame:
    """(path, error) of the rows at fault."""
    return rows.select("path", first_error(sheet, dict(rows.dtypes)).alias("error")).filter(F.col("error").isNotNull())


def _key(columns: tuple[str, ...], of: str = "") -> Column:
    """Normalised values as one text, each with its length before it, so no two keys are confused."""
    parts = [tx.norm(F.coalesce(F.col(f"{of}`{k}`").cast("string"), F.lit(""))) for k in columns]
    return F.concat(F.lit(""), *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def _identity(sheet: Sheet, have: list[str]) -> Column:
    """The normalised value of the first identity column that holds something; null without one."""
    found = []
    for name in sheet.identity:
        if name in have:
            text = F.col(f"`{name}`").cast("string")
            url = name in sheet.fields and sheet.fields[name].kind == "url"
            found.append(F.when(F.coalesce(text, F.lit("")) != "", tx.normalize_link(text) if url else tx.norm(text)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def duplicates(rows: DataFrame, key: list[str], sheet: Sheet | None = None) -> DataFrame:
    """(first_path, path) of rows that repeat an earlier row's normalised key, and its identity where a sheet has one."""
    full = F.concat_ws("\x1f", _key(tuple(key)), F.coalesce(_identity(sheet, rows.columns), F.lit("")) if sheet else F.lit(""))
    keyed = rows.withColumn("_key", full)
    firsts = keyed.groupBy("_key").agg(F.min("path").alias("first_path"))
    return keyed.join(firsts, "_key").filter(F.col("path") != F.col("first_path")).select("first_path", "path")


def upsert(base: DataFrame, incoming: DataFrame, sheet: Sheet) -> DataFrame:
    """(seq, path, action, changed) for each row of ``incoming`` (seq, columns of ``base``): matched by key and identity, else
    with the only row of its key if that has no identity, else inserted; without an identity, matched with the only row of
    its key, inserted where there is none, and ``ambiguous`` where there are more. ``update`` lists the fields that differ,
    cleared ones among them; ``none`` if none does.

    Rows meet by (key, identity) and by the sums of their keys, never as all pairs of a key."""
    b = base.withColumns({"_k": _key(sheet.key), "_id": _identity(sheet, base.columns)})
    n = incoming.withColumns({"_k": _key(sheet.key), "_id": _identity(sheet, incoming.columns)}).select("seq", "_k", "_id")
    by_key = b.groupBy("_k").agg(F.count(F.lit(1)).alias("_many"), F.count_if(F.col("_id").isNull()).alias("_bare"), F.min("path").alias("_only"))
    by_both = b.filter(F.col("_id").isNotNull()).groupBy("_k", "_id").agg(F.min("path").alias("_same"))
    met = n.join(by_key, "_k", "left").join(by_both, ["_k", "_id"], "left").withColumn("_many", F.coalesce("_many", F.lit(0)))
    lone = F.col("_many") == 1
    path = F.when(F.col("_id").isNull(), F.when(lone, F.col("_only"))).otherwise(F.coalesce("_same", F.when(lone & (F.col("_bare") == 1), F.col("_only"))))
    met = met.select("seq", path.alias("path"), (F.col("_id").isNull() & (F.col("_many") > 1)).alias("_unsure"))
    names = [c for c in incoming.columns if c in base.columns and c not in ("path", "seq", "created", "agent")]
    new = incoming.select("seq", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_new"))
    old = base.select("path", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_old"))
    rows = met.join(new, "seq").join(old, "path", "left")
    changed = F.array_compact(F.array(*[F.when(~F.col("_new")[c].eqNullSafe(F.col("_old")[c]), F.lit(c)) for c in names], F.lit(None).cast("string")))
    action = F.when(F.col("_unsure"), "ambiguous").when(F.col("path").isNull(), "insert").when(F.size(changed) == 0, "none").otherwise("update")
    return rows.select("seq", "path", action.alias("action"), F.when(action == "update", F.array_join(changed, ",")).alias("changed"))


def merged(base: DataFrame, incoming: DataFrame, done: DataFrame, sheet: Sheet, now: str, agent: str) -> DataFrame:
    """The sheet's rows after ``upsert`` (whose result is ``done``): updates take the given fields and the agent, inserts a
    path from the sheet's file name, with a number behind it where it is taken, and the time. The last of several updates
    of one row holds; ambiguous rows and ones at fault are left out (see ``refused``)."""
    from noteweave.sources.vault import free_names

    names = [c for c in incoming.columns if c in base.columns and c not in ("path", "seq", "created", "agent")]
    extra = {c: F.lit(None).cast("string") for c in ("created", "agent") if c not in base.columns}
    base = base.withColumns(extra)
    ok = incoming.withColumn("_error", first_error(sheet, dict(incoming.dtypes), ignored=("path", "seq"))).filter(F.col("_error").isNull()).drop("_error")
    rows = ok.drop("path").join(done.select("seq", "path", "action"), "seq")
    new = rows.filter("action = 'update'").groupBy("path").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), "seq").alias("_new"))
    kept = base.join(new, "path", "left").withColumns({**{c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(f"`{c}`")) for c in names}, "agent": F.when(F.col("_new").isNotNull(), F.lit(agent)).otherwise(F.col("agent"))}).drop("_new")
    wanted = rows.filter("action = 'insert'").withColumn("stem", tx.render(sheet.filename, list(sheet.fields)))
    named = free_names(wanted.select("seq", "stem"), base.select("path"))
    made = wanted.drop("path").join(named.select("seq", F.col("name").alias("_name")), "seq").withColumns({"path": F.concat(F.lit(f"{sheet.folder}/" if sheet.folder else ""), F.col("_name"), F.lit(".md")), "created": F.lit(now), "agent": F.lit(agent)})
    missing = [c for c in base.columns if c not in made.columns]
    made = made.withColumns({c: F.lit(None).cast(dict(base.dtypes)[c]) for c in missing})
    return kept.select(*base.columns).unionByName(made.select(*base.columns))


def refused(incoming: DataFrame, done: DataFrame, sheet: Sheet) -> DataFrame:
    """(seq, error) of the rows that ``merged`` leaves out."""
    rows = incoming.select("seq", first_error(sheet, dict(incoming.dtypes), ignored=("path", "seq")).alias("error")).join(done.select("seq", "action"), "seq")
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("action") == "ambiguous", F.lit("ambiguous: several rows share this key")))).filter(F.col("error").isNotNull()).select("seq", "error")


def log_entries(base: DataFrame, incoming: DataFrame, done: DataFrame, day: str, agent: str) -> DataFrame:
    """(seq, line) of the log line that each change of a ``status`` leaves in its row's note."""
    rows = done.filter(F.col("action").isin("insert", "update")).join(incoming.select("seq", F.col("status").alias("_to")), "seq").join(base.select("path", F.col("status").alias("_from")), "path", "left")
    rows = rows.filter(F.col("_to").isNotNull() & ~F.col("_from").eqNullSafe(F.col("_to")))
    return rows.select("seq", F.concat(F.lit(f"- {day} status: "), F.coalesce("_from", F.lit("(new)")), F.lit(" → "), "_to", F.lit(f" (agent: {agent})")).alias("line"))


def schema_notes(notes: DataFrame) -> DataFrame:
    """(folder, name, filename, key, identity, columns, error, instructions) of every schema note outside the agents' own
    folder; ``columns`` is a map of specifications, ``error`` says what is wrong with a schema that registers no sheet."""
    m = F.col("_meta")
    rows = notes.filter(F.col("path").rlike(rf"(^|/){SCHEMA}$") & (tx.top_folder(F.col("path")) != NOT_SHEETS)).withColumn("_meta", front.meta(F.col("text")))
    spec = "map<string,struct<type:string,required:boolean,values:array<string>,max_length:int>>"
    columns = F.from_json(front.as_json(F.col("text")), f"columns {spec}")["columns"]  # in the order they are written
    has = lambda k: F.try_variant_get(m, f"$.{k}", "variant").isNotNull()
    is_list = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(m, f"$.{k}", "variant")).startswith("ARRAY"), F.lit(False))
    rows = rows.select(F.regexp_replace("path", rf"/?{SCHEMA}$", "").alias("folder"), "_meta", "text", columns.alias("columns"))
    entries = F.array_sort(F.map_entries(F.coalesce("columns", F.create_map().cast(spec))))
    odd = F.get(F.filter(entries, lambda e: ~F.coalesce(e["value"]["type"].isin(*KINDS), F.lit(False))), 0)["key"]
    bare = F.get(F.filter(entries, lambda e: (e["value"]["type"] == "enum") & (F.coalesce(F.size(e["value"]["values"]), F.lit(0)) <= 0)), 0)["key"]
    error = F.coalesce(
        *[F.when(~has(k), F.lit(f"missing '{k}'")) for k in ("sheet", "filename", "key", "columns")],
        F.when(odd.isNotNull(), F.concat(F.lit("column '"), odd, F.lit("' has an invalid type"))),
        F.when(bare.isNotNull(), F.concat(F.lit("enum column '"), bare, F.lit("' needs values"))),
        F.when(~is_list("key"), F.lit("'key' is no list")),
        F.when(has("identity") & ~is_list("identity"), F.lit("'identity' is no list")),
    )
    return rows.select("folder", front.value(m, "sheet").alias("name"), front.value(m, "filename").alias("filename"), front.values(m, "key").alias("key"), front.values(m, "identity").alias("identity"), "columns", error.alias("error"), F.trim(F.regexp_replace(tx.body(F.col("text")), r"^\s+|\s+$", "")).alias("instructions"))


def discover(notes: DataFrame) -> DataFrame:
    """(name, folder) of the registered sheets; ValueError if two folders register one name."""
    good = schema_notes(notes).filter(F.col("error").isNull()).select("name", "folder")
    twice = good.groupBy("name").agg(F.array_sort(F.collect_list("folder")).alias("folders")).filter(F.size("folders") > 1).orderBy("name").first()
    if twice is not None:
        raise ValueError(f"duplicate sheet name {twice.name!r}: {', '.join(twice.folders)}")
    return good


def get_sheet(notes: DataFrame, name: str) -> Sheet:
    """A registered sheet's schema; KeyError with the names that there are."""
    names = discover(notes)
    found = schema_notes(notes).filter(F.col("error").isNull() & (F.col("name") == name)).withColumn("columns", F.map_entries("columns")).first()  # entries keep their order
    if found is None:
        raise KeyError(f"unknown sheet {name!r}; registered: {sorted(r.name for r in names.limit(100).collect())}")
    fields = {k: Field(v["type"], bool(v["required"]), tuple(v["values"] or ()), v["max_length"]) for k, v in found["columns"]}
    return Sheet(fields, tuple(found.key), tuple(found.identity), found.name, found.folder, found.filename)


def row_notes(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """(name, path, text) of the notes directly in the sheets' folders (name, folder), without their schemas."""
    rows = notes.filter(~F.col("path").rlike(rf"(^|/){SCHEMA}$")).withColumn("folder", F.regexp_replace("path", r"/?[^/]*$", ""))
    return rows.join(folders, "folder").select("name", "path", "text")


def sheet_rows(notes: DataFrame, sheet: Sheet, undeclared: bool = False) -> DataFrame:
    """The rows of one sheet, by path: its columns and the standard ones, read from front matter; numbers and truth values as
    text, and a list in a standard column as JSON."""
    folder = sheet.folder + "/"
    m = F.col("_meta")
    rows = notes.filter(F.col("path").startswith(folder) & ~F.contains(F.substr("path", F.lit(len(folder) + 1)), F.lit("/")) & (F.col("path") != folder + SCHEMA)).withColumn("_meta", front.meta(F.col("text")))
    wide = [F.coalesce(front.value(m, c), F.to_json(F.try_variant_get(m, f"$.{c}", "variant"))) if c in STANDARD else front.value(m, c) for c in (*sheet.fields, *STANDARD)]
    return rows.select("path", *[w.alias(c) for w, c in zip(wide, (*sheet.fields, *STANDARD), strict=True)], *([_undeclared(sheet).alias("_undeclared")] if undeclared else [])).orderBy(tx.path_key(F.col("path")))


def _undeclared(sheet: Sheet) -> Column:
    """The first key of front matter that the sheet does not have."""
    known = F.array(*map(F.lit, (*sheet.fields, *STANDARD)))
    return F.get(F.array_except(F.json_object_keys(F.to_json("_meta")), known), 0)


def check_notes(notes: DataFrame, sheet: Sheet) -> DataFrame:
    """(path, error) of a sheet's notes at fault; keys that are not declared are faults, too."""
    rows = sheet_rows(notes, sheet, undeclared=True)
    error = F.coalesce(first_error(sheet, {c: t for c, t in rows.dtypes if c != "_undeclared"}, required=False), F.concat("_undeclared", F.lit(": not declared")), first_error(sheet, {c: t for c, t in rows.dtypes if c != "_undeclared"}))
    return rows.select("path", error.alias("error")).filter(F.col("error").isNotNull())


def counts(notes: DataFrame) -> DataFrame:
    """(name, folder, rows, error) of every schema: the rows of each registered sheet, what is wrong with the others."""
    found = schema_notes(notes).select("name", "folder", "error")
    good = found.filter(F.col("error").isNull()).select("name", "folder")
    n = row_notes(notes, good).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    return found.join(n, "name", "left").select("name", "folder", F.when(F.col("error").isNull(), F.coalesce("rows", F.lit(0))).alias("rows"), "error")
