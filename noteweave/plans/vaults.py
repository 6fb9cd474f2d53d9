"""Registered queries on sheets in folders, recall, the manifest's life, consolidation, moves and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import blocking, consolidate, evals, graph, index, organize, plug, recall, sheets
from noteweave.plans.registry import query
from noteweave.plans.structure import CHANGED_SQL, snapshots
from noteweave.plans.tables import GRAPH_SQL, NOTES_SQL, edges, entities, marked_notes, mentions, notes, table
from noteweave.sources import graph_notes, vault

CUSTOMER_SCHEMA = """---
sheet: customers
filename: '{name}'
key: [name]
columns:
  name: {type: string, required: true}
  segment: {type: string, required: true}
  since: {type: date}
  active:
    type: bool
---

Keep it tidy.
"""


def sheet_vault(spark, sf_dir):
    """Customers as notes of a sheet's folder, some below it, and a schema for each region, all but one at fault."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Sheets/Customers/"), F.when(k % 29 == 0, F.lit("old/")).otherwise(F.lit("")), F.lpad(k.cast("string"), 7, "0"), F.lit(".md")).alias("path"),
        F.concat(F.lit("---\nname: "), "c_name", F.lit("\nsegment: "), F.when(k % 17 != 0, F.col("c_mktsegment")).otherwise(F.lit("")), F.lit("\nsince: "), F.when(k % 13 == 0, F.lit("2024")).otherwise(F.lit("2024-01-02")),
                 F.lit("\nactive: "), F.when(k % 19 == 0, F.lit("maybe")).otherwise(F.lit("yes")), F.when(k % 23 == 0, F.lit("\nextra: 1")).otherwise(F.lit("")), F.lit("\ntags:\n- a\n- 'b'\n---\n\nnotes\n")).alias("text"),
    )
    r = F.col("r_regionkey")
    bad = F.concat(F.lit("---\nsheet: "), "r_name", F.when(r % 3 == 0, F.lit("\nfilename: x")).otherwise(F.lit("")), F.lit("\nkey: [k]\ncolumns:\n  k: {type: "), F.when(r == 3, F.lit("odd")).otherwise(F.lit("string")), F.lit("}\n---\n"))
    more = table(spark, sf_dir, "region").select(F.concat(F.when(r == 4, F.lit("Claude/")).otherwise(F.lit("R/")), "r_name", F.lit("/_schema.md")).alias("path"), bad.alias("text"))
    return rows.union(spark.createDataFrame([("Sheets/Customers/_schema.md", CUSTOMER_SCHEMA)], "path string, text string")).union(more)


@query("sheet_registry", """SELECT 'customers' AS name, 'Sheets/Customers' AS folder, (SELECT count(*) FROM customer WHERE c_custkey % 29 <> 0) AS rows, NULL AS error
 UNION ALL SELECT r_name, 'R/' || r_name, CASE WHEN r_regionkey = 0 THEN 0 END, CASE WHEN r_regionkey % 3 <> 0 THEN 'missing ''filename''' WHEN r_regionkey = 3 THEN 'column ''k'' has an invalid type' END FROM region WHERE r_regionkey <> 4""")
def sheet_registry(spark, sf_dir):
    return sheets.counts(sheet_vault(spark, sf_dir))


NOTE_ROWS_SQL = "SELECT 'Sheets/Customers/' || lpad(c_custkey::VARCHAR, 7, '0') || '.md' AS path, c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 13 = 0 THEN '2024' ELSE '2024-01-02' END AS since, CASE WHEN c_custkey % 19 = 0 THEN 'maybe' ELSE 'true' END AS active FROM customer WHERE c_custkey % 29 <> 0"


@query("sheet_notes", f"""SELECT path, name, segment, since, active, '["a","b"]' AS tags FROM ({NOTE_ROWS_SQL})""")
def sheet_notes(spark, sf_dir):
    v = sheet_vault(spark, sf_dir)
    return sheets.sheet_rows(v, sheets.get_sheet(v, "customers")).select("path", "name", "segment", "since", "active", "tags")


@query("sheet_notes_check", f"SELECT path, CASE WHEN k % 13 = 0 THEN 'since: not a date' WHEN k % 19 = 0 THEN 'active: not a bool' WHEN k % 23 = 0 THEN 'extra: not declared' ELSE 'segment: missing' END AS error FROM ({NOTE_ROWS_SQL}) WHERE k % 13 = 0 OR k % 19 = 0 OR k % 17 = 0 OR k % 23 = 0")
def sheet_notes_check(spark, sf_dir):
    v = sheet_vault(spark, sf_dir)
    return sheets.check_notes(v, sheets.get_sheet(v, "customers"))


@query("file_names", r"""WITH r AS (SELECT c_custkey AS seq, rtrim(trim(regexp_replace(regexp_replace(substr(c_name, 1, 12) || ': ' || c_nationkey, '[\\/:*?"<>|]', '-', 'g'), '\s+', ' ', 'g'))[:120]) AS clean FROM customer)
 SELECT seq, CASE WHEN n = 1 THEN clean ELSE clean || ' ' || n END AS name FROM (SELECT seq, clean, row_number() OVER (PARTITION BY clean ORDER BY seq) + CASE WHEN clean LIKE '%- 3' OR clean LIKE '%- 5' THEN 1 ELSE 0 END AS n FROM r)""")
def file_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.substring("c_name", 1, 12).alias("name"), F.col("c_nationkey").alias("place"))
    stems = c.select("seq", tx.render("{name}: {place}", ["name", "place"]).alias("stem"))
    taken = stems.filter(F.col("stem").endswith("- 3") | F.col("stem").endswith("- 5")).select(F.concat(F.lit("x/"), F.upper("stem"), F.lit(".md")).alias("path")).distinct()
    return vault.free_names(stems, taken).select("seq", "name")


MTIME = "2024-06-15 12:30:00"


def sessions_vault(spark, sf_dir):
    """conversations as notes on sessions, nations as a list of decisions."""
    conv, turn = F.col("conv_id"), F.col("turn")
    created = F.when(turn % 3 != 0, F.concat(F.lit("created: 2024-"), F.lpad((conv % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((turn % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00\n"))).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("Claude/Sessions/s"), conv.cast("string"), F.lit("-"), turn.cast("string"), F.when(conv % 9 == 0, F.lit(" Apollo")).otherwise(F.lit("")), F.lit(".md")).alias("path"),
        F.concat(F.lit("---\nproject: '"), F.when(conv % 5 == 0, F.lit("apollo x")).otherwise(F.lit("other")), F.lit("'\n"), created, F.lit("---\n\n"), "text").alias("text"), F.lit(MTIME).cast("timestamp").alias("mtime"),
    )
    line = lambda x: F.concat(F.when(x["n_nationkey"] % 4 == 0, F.lit("* ")).otherwise(F.lit("- ")), x["n_name"], F.when(x["n_nationkey"] % 3 == 0, F.lit(" for Apollo")).otherwise(F.lit("")))
    lines = table(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), line), "\n").alias("text"))
    return rows.union(lines.select(F.lit("Claude/Decisions.md"), "text", F.lit(MTIME).cast("timestamp")))


SESSIONS_SQL = r"""s AS (SELECT 'Claude/Sessions/s' || conv_id || '-' || turn || CASE WHEN conv_id % 9 = 0 THEN ' Apollo' ELSE '' END || '.md' AS path, CASE WHEN turn % 3 <> 0 THEN '2024-' || lpad((conv_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((turn % 28 + 1)::VARCHAR, 2, '0') || ' 10:00' ELSE '2024-06-15 12:30' END AS created,
  trim(regexp_replace(chr(10) || chr(10) || text, '\s+', ' ', 'g'))[:400] AS excerpt FROM conversations WHERE conv_id % 5 = 0 OR conv_id % 9 = 0),
 d AS (SELECT n_nationkey AS number, '- ' || n_name || ' for Apollo' AS line FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 4 <> 0)"""


@query("recall_sessions", f"WITH {SESSIONS_SQL} SELECT path, created, excerpt FROM s ORDER BY created DESC, string_split(path, '/') LIMIT 10")
def recall_sessions(spark, sf_dir):
    return recall.sessions(sessions_vault(spark, sf_dir), "Apollo")


@query("recall_decisions", f"WITH {SESSIONS_SQL} SELECT number, line FROM d")
def recall_decisions(spark, sf_dir):
    return recall.decisions(sessions_vault(spark, sf_dir), "APOLLO").select("number", "line")


def timed_notes(spark, sf_dir):
    return marked_notes(spark, sf_dir).withColumn("mtime", F.timestamp_add("DAY", (F.col("doc_id") % 30).cast("int"), F.lit("2024-01-01 08:00:00").cast("timestamp")))


@query("done_recently", f"WITH {NOTES_SQL} SELECT path, 'review [[src/' || source || '|s]]' AS task FROM notes WHERE doc_id % 2 = 0 AND doc_id % 30 >= 19")
def done_recently(spark, sf_dir):
    return recall.done_recently(timed_notes(spark, sf_dir), F.lit("2024-01-20").cast("timestamp")).select("path", "task")


@query("recall_changed", f"WITH {NOTES_SQL} SELECT path, '2024-01-' || lpad((doc_id % 30 + 1)::VARCHAR, 2, '0') || ' 08:00' AS modified FROM notes WHERE doc_id % 30 >= 25 AND path LIKE 'src1/%'")
def recall_changed(spark, sf_dir):
    return recall.changed(timed_notes(spark, sf_dir), F.lit("2024-01-26").cast("timestamp"), "src1")


@query("context_lines", rf"""WITH {SESSIONS_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY created DESC, string_split(path, '/')) - 1 AS number FROM s) SELECT 0 AS part, number, 'Session: ' || regexp_extract(path, '([^/]+)\.md$', 1) || ' — ' || excerpt[:300] AS line FROM f WHERE number < 3
 UNION ALL SELECT 2, number, line FROM (SELECT number, line FROM d ORDER BY number LIMIT 3)""")
def context_lines(spark, sf_dir):
    return recall.context_lines(sessions_vault(spark, sf_dir), "apollo").select("part", F.col("number").cast("long").alias("number"), "line")


@query("index_batch", f"WITH due AS ({CHANGED_SQL} SELECT c.path FROM cur c LEFT JOIN man m ON m.path = c.path WHERE (m.hash IS DISTINCT FROM c.hash OR c.doc_id % 13 = 0) AND NOT (c.doc_id % 13 = 0 AND c.doc_id % 4 >= 3)) SELECT path, (SELECT greatest(count(*) - 25, 0) FROM due) AS remaining FROM due ORDER BY string_split(path, '/') LIMIT 25")
def index_batch(spark, sf_dir):
    current, manifest, n = snapshots(spark, sf_dir)
    first, rest = index.next_batch(index.pending(current, manifest, n.filter("doc_id % 13 = 0").select("path", (F.col("doc_id") % 4).alias("attempts"))))
    return first.join(F.broadcast(rest))


def batch_done(spark, sf_dir):
    current, manifest, n = snapshots(spark, sf_dir)
    value = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.lit("slow").alias("error"), (F.col("doc_id") % 4).alias("attempts")))).otherwise(F.lit('"broken"'))
    failures = index.normal_failures(n.filter("doc_id % 13 = 0").select("path", value.alias("value")), ["src0/fr/0.md"])
    done = n.filter("doc_id % 6 < 2").select("path", F.when(F.col("doc_id") % 6 == 1, F.repeat(F.lit("no answer "), 40)).alias("error")).join(current.select("path"), "path", "left_semi")
    return index.after_batch(current, manifest, failures, done)


@query("manifest_after", f"{CHANGED_SQL} SELECT path, hash FROM man WHERE NOT (doc_id % 6 = 0 AND doc_id % 11 <> 0) UNION ALL SELECT path, hash FROM cur WHERE doc_id % 6 = 0")
def manifest_after(spark, sf_dir):
    return batch_done(spark, sf_dir)[0]


@query("failures_after", f"""WITH {NOTES_SQL}, f AS (SELECT path, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'slow' ELSE 'broken' END AS error, (CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 ELSE 1 END)::INTEGER AS attempts FROM notes WHERE doc_id % 13 = 0 AND path <> 'src0/fr/0.md')
 SELECT path, error, attempts FROM f WHERE NOT (doc_id % 6 < 2 AND doc_id % 11 <> 0) UNION ALL SELECT n.path, repeat('no answer ', 30), (coalesce(f.attempts, 0) + 1)::INTEGER FROM notes n LEFT JOIN f USING (path) WHERE n.doc_id % 6 = 1 AND n.doc_id % 11 <> 0""")
def failures_after(spark, sf_dir):
    return batch_done(spark, sf_dir)[1]


@query("index_preview", f"{CHANGED_SQL} SELECT c.path FROM cur c LEFT JOIN man m ON m.path = c.path WHERE m.hash IS DISTINCT FROM c.hash OR c.doc_id % 13 = 0")
def index_preview(spark, sf_dir):
    current, manifest, n = snapshots(spark, sf_dir)
    return index.preview(current, manifest, n.filter("doc_id % 13 = 0").select("path", F.lit(9).alias("attempts")))


@query("prune_cache", f"{CHANGED_SQL} SELECT man.path, (SELECT count(*) FROM man WHERE path NOT IN (SELECT path FROM cur)) AS pruned FROM man WHERE path IN (SELECT path FROM cur)")
def prune_cache(spark, sf_dir):
    current, manifest, _ = snapshots(spark, sf_dir)
    kept, gone = index.pruned(manifest, current)
    return kept.select("path").join(F.broadcast(gone))


@query("replace_mentions", f"WITH {GRAPH_SQL} SELECT DISTINCT entity, note FROM mentions WHERE regexp_extract(note, '[0-9]+')::BIGINT % 4 <> 0 UNION SELECT 'P/' || (o_orderkey % 50), 'O/' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def replace_mentions(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").filter(k % 4 == 0).select(F.concat(F.lit("O/"), k.cast("string")).alias("path"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("P/"), (k % 50).cast("string")).alias("entity"))
    return plug.replace_mentions(mentions(spark, sf_dir), o, o.select("entity", F.col("path").alias("note")))


def twins(spark, sf_dir):
    """Parts as entities; one of four has a neighbour whose name differs in case and signs only."""
    k = F.col("p_partkey")
    quarter = F.floor(k / 4).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("Part "), quarter)).when(k % 4 == 1, F.concat(F.lit("part-"), quarter)).otherwise(F.concat("p_name", F.lit(" "), k.cast("string")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("T/"), F.lpad(k.cast("string"), 7, "0")).alias("path"), name.alias("name"), F.lit("topic").alias("type"), F.array(F.col("p_brand")).alias("aliases"), F.col("p_type").alias("summary"))


def twin_pairs(spark, sf_dir):
    k = F.col("p_partkey")
    path = lambda c: F.concat(F.lit("T/"), F.lpad(c.cast("string"), 7, "0"))
    p = table(spark, sf_dir, "part").filter((k % 4 != 0) & (k > 3)).select(path(k - k % 4).alias("a"), path(k).alias("b"))
    known = twins(spark, sf_dir).select(F.col("path").alias("a"))
    return p.join(known, "a", "left_semi")


TWIN_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'Part ' || (p_partkey // 4) WHEN 1 THEN 'part-' || (p_partkey // 4) ELSE p_name || ' ' || p_partkey END"


@query("entity_identities", f"SELECT 'T/' || lpad(p_partkey::VARCHAR, 7, '0') AS path, sha256({TWIN_SQL} || chr(10) || p_brand || chr(10) || p_type) AS hash, 'topic | ' || {TWIN_SQL} || ' | ' || p_brand AS line FROM part")
def entity_identities(spark, sf_dir):
    e = twins(spark, sf_dir)
    return consolidate.identities(e).select("path", "hash").join(e.select("path", tx.listing(F.col("type"), F.col("name"), F.col("aliases")).alias("line")), "path")


MERGED_SQL = "x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 AND p_partkey > 3 AND p_partkey - 1 IN (SELECT p_partkey FROM part) THEN p_partkey - 1 ELSE p_partkey END AS c FROM part)"


@query("adjudicate_merges", f"WITH {MERGED_SQL} SELECT 'topic' AS type, 'Part ' || (c // 4) AS canonical, 'part-' || (c // 4) AS duplicates FROM x WHERE c <> p_partkey")
def adjudicate_merges(spark, sf_dir):
    merges, _ = consolidate.propose(twins(spark, sf_dir), twin_pairs(spark, sf_dir), plug.same_letters)
    return merges.select("type", "canonical", F.array_join("duplicates", ",").alias("duplicates"))


@query("consolidate", f"""WITH {MERGED_SQL}, n AS (SELECT c, count(DISTINCT l_orderkey) AS n FROM x JOIN lineitem ON l_partkey = p_partkey GROUP BY c)
 SELECT 'T/' || lpad(x.p_partkey::VARCHAR, 7, '0') AS path, CASE WHEN x.c <> x.p_partkey THEN 'T/' || lpad(x.c::VARCHAR, 7, '0') END AS next, CASE WHEN x.c = x.p_partkey THEN coalesce(n.n, 0) END AS mentions FROM x LEFT JOIN n ON n.c = x.p_partkey""")
def consolidate_(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.concat(F.lit("T/"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("entity"), F.concat(F.lit("O/"), F.col("l_orderkey").cast("string")).alias("note"))
    none = spark.createDataFrame([], "src string, rel string, dst string")
    kept, moved, _, stubs = consolidate.run(twins(spark, sf_dir), m, none, twin_pairs(spark, sf_dir), plug.same_letters)
    n = moved.groupBy(F.col("entity").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    live = kept.select("path", F.lit(None).cast("string").alias("next")).join(n, "path", "left").select("path", "next", F.coalesce("n", F.lit(0)).alias("mentions"))
    return live.unionByName(stubs.select("path", "next", F.lit(None).cast("long").alias("mentions")))


@query("entity_upsert", "SELECT 'P/' || p_partkey AS path, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS n_aliases, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'revived' ELSE 'extended' END ELSE 'kept' END AS action FROM part UNION ALL SELECT 'Claude/Graph/Topics/Supplier ' || s_suppkey, 'Supplier: ' || s_suppkey, 0, 'created' FROM supplier")
def entity_upsert(spark, sf_dir):
    e = entities(spark, sf_dir)
    k = F.substring("path", 3, 20).cast("long")
    own = F.array(F.concat(F.lit("part "), k.cast("string")), F.concat(F.lit("brand of "), k.cast("string")))
    known = e.select("path", "name", F.lit("topic").alias("type"), own.alias("aliases"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("next"), (k % 7 == 0).alias("gone"))
    again = known.filter(k % 3 == 0).select(F.concat(F.lit("PART "), k.cast("string")).alias("name"), "type", F.array(F.concat(F.lit("new "), k.cast("string"))).alias("aliases"), F.lit("seen").alias("summary"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier: "), F.col("s_suppkey").cast("string")).alias("name"), F.lit("topic").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("summary"))
    done = graph_notes.upsert_entities(known, again.unionByName(s))
    return done.select("path", "name", F.size("aliases").cast("long").alias("n_aliases"), "action")


def moves_of(spark, sf_dir):
    """Each seventh document goes to a folder by its language."""
    return notes(spark, sf_dir).filter("doc_id % 7 = 3").select(F.col("path").alias("source"), F.concat(F.lit("filed/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("to"))


def linked_notes(spark, sf_dir):
    stem = F.regexp_replace("path", r"\.md$", "")
    return notes(spark, sf_dir).select("path", F.concat(F.lit("See [["), stem, F.lit("]] and [["), stem, F.lit("|me]], not [["), stem, F.lit("x]] or [[elsewhere#a]].")).alias("text"))


MOVES_SQL = r"n AS (SELECT doc_id, path, regexp_replace(path, '\.md$', '') AS stem, CASE WHEN doc_id % 7 = 3 THEN 'filed/' || lang || '/' || doc_id ELSE regexp_replace(path, '\.md$', '') END AS place FROM notes)"


@query("apply_moves", f"WITH {NOTES_SQL}, {MOVES_SQL} SELECT place || '.md' AS path, 'See [[' || place || ']] and [[' || place || '|me]], not [[' || stem || 'x]] or [[elsewhere#a]].' AS text FROM n")
def apply_moves(spark, sf_dir):
    return organize.apply_moves(linked_notes(spark, sf_dir), moves_of(spark, sf_dir))[0]


@query("moved_links", f"WITH {NOTES_SQL}, {MOVES_SQL} SELECT path, place || '.md' AS \"to\", 2 AS count FROM n WHERE doc_id % 7 = 3")
def moved_links(spark, sf_dir):
    return organize.apply_moves(linked_notes(spark, sf_dir), moves_of(spark, sf_dir))[1].select("path", "to", "count")


@query("transfer_manifest", f"WITH {NOTES_SQL} SELECT CASE WHEN doc_id % 7 = 3 THEN 'filed/' || lang || '/' || doc_id || '.md' ELSE path END AS path, sha256(text) AS hash FROM notes")
def transfer_manifest(spark, sf_dir):
    return organize.transfer(index.hashes(notes(spark, sf_dir)), moves_of(spark, sf_dir))


@query("undo_moves", "SELECT event_id AS seq, event_type = 'error' OR (event_id = coalesce(max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id), -1) AND user_id % 2 = 0) AS undone FROM events")
def undo_moves(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    journal = ev.select(F.col("event_id").alias("seq"), F.concat(F.lit("in/"), F.col("event_id").cast("string")).alias("source"), F.col("user_id").cast("string").alias("to"), (F.col("event_type") == "error").alias("undone"))
    marked, _ = organize.undo(journal, ev.filter("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("to")))
    return marked.select("seq", "undone")


@query("eval_lenient", """WITH g AS (SELECT doc_id, source, doc_id % 3 = 0 AS missing, quality = 1 AS expect FROM labels JOIN documents USING (doc_id) WHERE quality = 1 OR toxic = 1)
 SELECT source, round(count(*) FILTER (expect AND doc_id % 10 < 4) / count(*) FILTER (expect), 6) AS recall, min(CASE WHEN doc_id % 10 < 4 THEN doc_id % 10 + 1 END) AS first_rank FROM g WHERE NOT missing GROUP BY source HAVING count(*) FILTER (expect) > 0""")
def eval_lenient(spark, sf_dir):
    """A golden set by source, a third of whose paths leave the vault or are in no folder of it."""
    g = table(spark, sf_dir, "labels").filter("quality = 1 OR toxic = 1").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit("../")).otherwise(F.lit("gone/"))).otherwise(F.lit("n/")), F.col("doc_id").cast("string"))
    lists = g.groupBy(F.col("source").alias("id")).agg(F.collect_set(F.when(F.col("quality") == 1, path)).alias("expect"), F.collect_set(F.when(F.col("quality") != 1, path)).alias("accept"))
    there = g.filter("doc_id % 3 <> 0 OR doc_id % 2 = 0").select(path.alias("path"))
    hits = g.filter("doc_id % 10 < 4").select(F.col("source").alias("query"), path.alias("item"), (F.col("doc_id") % 10 + 1).alias("rank"))
    done = evals.per_query(evals.judged_items(lists, there), hits, 10)
    return done.select(F.col("query").alias("source"), F.round("recall", 6).alias("recall"), F.col("first_rank").cast("long").alias("first_rank"))


@query("config_merge", "SELECT coalesce(i.n_name, w.n_name) AS name, CASE WHEN i.n_name IS NULL THEN 'b,c' WHEN w.n_name IS NULL THEN 'a,b' ELSE 'a,b,c' END AS values FROM (SELECT n_name FROM nation WHERE n_nationkey > 4) i FULL JOIN (SELECT n_name FROM nation WHERE n_nationkey < 20) w ON i.n_name = w.n_name")
def config_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    have = lambda *v: F.array(*map(F.lit, v)).alias("values")
    return index.additive(n.filter("n_nationkey > 4").select("name", have("a", "b")), n.filter("n_nationkey < 20").select("name", have("b", "c"))).select("name", F.array_join("values", ",").alias("values"))


@query("slice_cursor", "WITH s AS (SELECT vec_id::VARCHAR AS path, vec_id % 3 = 0 AS checked FROM embeddings), t AS (SELECT *, row_number() OVER (ORDER BY checked, checked AND path <= '2', path) AS n FROM s) SELECT count(*) FILTER (n <= 400) AS taken, coalesce(max_by(path, n) FILTER (checked AND n <= 400), '2') AS cursor FROM t")
def slice_cursor(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), (F.col("vec_id") % 3 == 0).alias("checked"))
    part = blocking.select_slice(rows, "2", 400)
    return part.agg(F.count(F.lit(1)).alias("taken")).withColumn("cursor", F.lit(blocking.next_cursor(rows, part, "2")))


@query("retirements", f"WITH {GRAPH_SQL} SELECT path FROM entities WHERE path NOT IN (SELECT entity FROM mentions WHERE regexp_extract(note, '[0-9]+')::BIGINT % 300 = 1) AND regexp_extract(path, '[0-9]+')::BIGINT % 2 = 0")
def retirements(spark, sf_dir):
    e = entities(spark, sf_dir)
    few = mentions(spark, sf_dir).filter(F.substring("note", 3, 20).cast("long") % 300 == 1)
    return graph.retirements(e, few, edges(spark, sf_dir).limit(0), e.filter(F.substring("path", 3, 20).cast("long") % 2 == 0))


@query("json_rows", """SELECT o_orderkey AS seq, '{"key":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","tags":["' || o_orderstatus || '",null],"more":{"none":null}}' AS json FROM orders""")
def json_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    row = F.struct(F.col("o_orderkey").alias("key"), F.to_date(day).alias("day"), day.alias("at"), F.array(F.col("o_orderstatus"), F.lit(None).cast("string")).alias("tags"), F.struct(F.lit(None).cast("string").alias("none")).alias("more"))
    return o.select(F.col("o_orderkey").alias("seq"), tx.json_safe(row).alias("json"))


@query("mention_lines", f"WITH {GRAPH_SQL}, e AS (SELECT DISTINCT entity, note FROM mentions), x AS (SELECT entity, note FROM e WHERE regexp_extract(note, '[0-9]+')::BIGINT % 2 = 0) SELECT entity, note, 'old' AS evidence FROM x UNION ALL SELECT entity, note, 'new' FROM e WHERE regexp_extract(note, '[0-9]+')::BIGINT % 3 = 0 AND (entity, note) NOT IN (SELECT (entity, note) FROM x)")
def mention_lines(spark, sf_dir):
    m = mentions(spark, sf_dir).distinct()
    n = F.substring("note", 3, 20).cast("long")
    return plug.add_mentions(m.filter(n % 2 == 0).withColumn("evidence", F.lit("old")), m.filter(n % 3 == 0).withColumn("evidence", F.lit("new")))
