"""Registered graph, blocking, filing, indexing and sheet queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteweave.operators import blocking, graph, health, index, organize, rank, sheets, sweep
from noteweave.plans.registry import query
from noteweave.plans.retrieval import bm25_sql
from noteweave.plans.tables import GRAPH_SQL, NOTES_SQL, edges, entities, mentions, notes, table, vectors


@query("find_entity", f"""WITH {GRAPH_SQL}, f AS (SELECT * FROM entities WHERE contains(lower(name), 'ring') OR len(list_filter(aliases, lambda x: contains(lower(x), 'ring'))) > 0)
 SELECT f.path, f.name, (SELECT count(*) FROM mentions m WHERE m.entity = f.path) AS mention_count,
   coalesce((SELECT array_to_string(list_sort(list(rel || ' ' || regexp_extract(dst, '[^/]+$'))), ',') FROM edges e WHERE e.src = f.path), '') AS relations FROM f""")
def find_entity(spark, sf_dir):
    found = graph.find_entity(entities(spark, sf_dir), mentions(spark, sf_dir), edges(spark, sf_dir), "RING")
    return found.select("path", "name", "mention_count", F.array_join("relations", ",").alias("relations"))


@query("graph_stats", f"WITH {GRAPH_SQL} SELECT 'type:' || type AS kind, count(*) AS n FROM entities GROUP BY type UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'mentions', count(*) FROM mentions")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(entities(spark, sf_dir), mentions(spark, sf_dir), edges(spark, sf_dir))


@query("note_entities", f"WITH {GRAPH_SQL} SELECT DISTINCT entity FROM mentions WHERE note = 'O/7'")
def note_entities(spark, sf_dir):
    return graph.note_entities(mentions(spark, sf_dir), "O/7")


SEED_SQL = "seed AS (SELECT DISTINCT entity FROM mentions WHERE note = 'O/7')"


@query("related_notes_1hop", f"WITH {GRAPH_SQL}, {SEED_SQL} SELECT note, 0 AS depth, min(entity) AS via FROM mentions JOIN seed USING (entity) WHERE note <> 'O/7' GROUP BY note")
def related_notes_1hop(spark, sf_dir):
    return graph.related_notes(mentions(spark, sf_dir), edges(spark, sf_dir), "O/7", hops=1)


RELATED_SQL = f"""WITH {GRAPH_SQL}, {SEED_SQL}, sym AS (SELECT src, rel, dst FROM edges UNION SELECT dst, rel, src FROM edges),
 h1 AS (SELECT dst AS entity, 1 AS depth, min(s.entity || ' (' || rel || ') ' || dst) AS via FROM seed s JOIN sym b ON b.src = s.entity WHERE dst NOT IN (SELECT entity FROM seed) GROUP BY dst),
 h2 AS (SELECT dst AS entity, 2 AS depth, min(h1.via || ' (' || rel || ') ' || dst) AS via FROM h1 JOIN sym b ON b.src = h1.entity WHERE dst NOT IN (SELECT entity FROM seed UNION SELECT entity FROM h1) GROUP BY dst),
 reached AS (SELECT entity, 0 AS depth, entity AS via FROM seed UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)
 SELECT note, min((depth, via))[1]::INTEGER AS depth, min((depth, via))[2] AS via FROM mentions JOIN reached USING (entity) WHERE note <> 'O/7' GROUP BY note"""


@query("related_notes_3hop", RELATED_SQL)
def related_notes_3hop(spark, sf_dir):
    return graph.related_notes(mentions(spark, sf_dir), edges(spark, sf_dir), "O/7", hops=3)


@query("serendipity", f"SELECT note, via FROM ({RELATED_SQL}) WHERE depth >= 1")
def serendipity(spark, sf_dir):
    return related_notes_3hop(spark, sf_dir).filter("depth >= 1").select("note", "via")


ORDER_NOTES_SQL = "notes AS (SELECT o_orderkey AS doc_id, 'O/' || o_orderkey AS path, o_orderpriority || ' order of ' || o_orderstatus || chr(10) || 'customer ' || o_custkey AS text FROM orders)"


def order_notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("O/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat("o_orderpriority", F.lit(" order of "), "o_orderstatus", F.lit("\ncustomer "), F.col("o_custkey").cast("string")).alias("text"))


@query("context_bundle", f"""WITH {GRAPH_SQL}, {ORDER_NOTES_SQL}, {bm25_sql('true', "urgent customer 7".split())},
 vr AS (SELECT 'O/' || e.vec_id AS path, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM embeddings e JOIN orders ON o_orderkey = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE score > 0 QUALIFY rank <= 50),
 fused AS (SELECT path, sum(1.0 / (60 + rank)) AS score, min((l, rank)) AS first FROM (SELECT path, rank, 0 AS l FROM bm UNION ALL SELECT path, rank, 1 FROM vr) GROUP BY path),
 hits AS (SELECT path AS note, row_number() OVER (ORDER BY round(score, 12) DESC, first) AS rank FROM fused QUALIFY rank <= 10),
 seed AS (SELECT DISTINCT h.note AS seed, m.entity FROM hits h JOIN mentions m ON m.note = h.note), sym AS (SELECT src, rel, dst FROM edges UNION SELECT dst, rel, src FROM edges),
 h1 AS (SELECT s.seed, dst AS entity, 1 AS depth, min(s.entity || ' (' || rel || ') ' || dst) AS via FROM seed s JOIN sym b ON b.src = s.entity WHERE (s.seed, dst) NOT IN (SELECT (seed, entity) FROM seed) GROUP BY s.seed, dst),
 reached AS (SELECT seed, entity, 0 AS depth, entity AS via FROM seed UNION ALL SELECT * FROM h1),
 rel AS (SELECT m.note, min((h.rank, r.depth, r.via)) AS first FROM reached r JOIN mentions m ON m.entity = r.entity JOIN hits h ON h.note = r.seed WHERE m.note <> r.seed GROUP BY m.note)
 SELECT 'entity' AS kind, m.entity AS path, min(h.rank) AS first_hit, count(DISTINCT m.note) AS hits, NULL AS via FROM hits h JOIN mentions m ON m.note = h.note GROUP BY m.entity
 UNION ALL SELECT 'related', note, first[1], first[2], first[3] FROM rel""")
def context_bundle(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("O/"), F.col("vec_id").cast("string")).alias("path"), F.col("embedding").alias("vec"))
    asked = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("qvec"))
    hits = rank.hybrid(order_notes(spark, sf_dir), v, "urgent customer 7", asked, limit=10)
    found, related = graph.context_bundle(hits.select("path", "rank"), mentions(spark, sf_dir), edges(spark, sf_dir))
    a = found.select(F.lit("entity").alias("kind"), F.col("entity").alias("path"), F.col("first_hit").cast("long").alias("first_hit"), "hits", F.lit(None).cast("string").alias("via"))
    return a.unionByName(related.select(F.lit("related").alias("kind"), F.col("note").alias("path"), F.col("first_hit").cast("long").alias("first_hit"), F.col("depth").cast("long").alias("hits"), "via"))


def redirects(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P/"), c.cast("string"))
    following = F.when(k % 10 == 3, name(k + 7)).when(k % 10 == 0, F.when(k % 20 == 0, name(k + 1))).when(k % 10 == 7, name(k + 1)).when(k % 10 == 8, name(k - 1))
    return table(spark, sf_dir, "part").select(name(k).alias("path"), following.alias("next"), (k % 30 == 1).alias("gone"))


REDIRECT_SQL = """r AS (SELECT 'P/' || p_partkey AS path, CASE WHEN p_partkey % 10 = 3 THEN 'P/' || (p_partkey + 7) WHEN p_partkey % 20 = 0 THEN 'P/' || (p_partkey + 1) WHEN p_partkey % 10 = 7 THEN 'P/' || (p_partkey + 1)
   WHEN p_partkey % 10 = 8 THEN 'P/' || (p_partkey - 1) END AS next, p_partkey % 30 = 1 AS gone FROM part),
 walk AS (SELECT path, path AS at, 0 AS d FROM r UNION ALL SELECT w.path, r.next, d + 1 FROM walk w JOIN r ON r.path = w.at WHERE r.next IS NOT NULL AND d < 5),
 resolved AS (SELECT p.path, t.at AS target FROM r p LEFT JOIN (SELECT w.path, w.at FROM walk w JOIN r ON r.path = w.at WHERE r.next IS NULL AND NOT r.gone) t ON t.path = p.path)"""


@query("resolve_redirect", f"WITH RECURSIVE {REDIRECT_SQL} SELECT path, target FROM resolved")
def resolve_redirect(spark, sf_dir):
    return graph.resolve_redirects(redirects(spark, sf_dir))


@query("flatten_stubs", f"WITH RECURSIVE {REDIRECT_SQL} SELECT r.path, CASE WHEN target IS NULL THEN 'retire' WHEN target <> next THEN 'flatten' ELSE 'keep' END AS action, target FROM r JOIN resolved USING (path) WHERE next IS NOT NULL")
def flatten_stubs(spark, sf_dir):
    return graph.flatten_redirects(redirects(spark, sf_dir))


PART_EDGES_SQL = "pe AS (SELECT DISTINCT 'P/' || l_partkey AS src, 'with' AS rel, 'P/' || (l_partkey + l_suppkey) AS dst FROM lineitem)"


def part_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("P/"), F.col("l_partkey").cast("string")).alias("src"), F.lit("with").alias("rel"), F.concat(F.lit("P/"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string")).alias("dst")).distinct()


REPAIR_SQL = f"""WITH RECURSIVE {REDIRECT_SQL}, {PART_EDGES_SQL}, x AS (SELECT pe.*, t.target FROM pe JOIN resolved s ON s.path = pe.src AND s.target = s.path LEFT JOIN resolved t ON t.path = pe.dst),
 y AS (SELECT x.*, k.src IS NOT NULL AS have, row_number() OVER (PARTITION BY x.src, x.target, x.dst = x.target ORDER BY x.dst) AS rn FROM x LEFT JOIN (SELECT DISTINCT src, target FROM x WHERE dst = target) k ON k.src = x.src AND k.target = x.target),
 z AS (SELECT *, CASE WHEN target IS NULL THEN 'removed' WHEN target = dst THEN 'kept' WHEN have OR rn > 1 THEN 'removed' ELSE 'retargeted' END AS action FROM y)"""


def repaired(spark, sf_dir):
    return graph.repair_relations(part_edges(spark, sf_dir), graph.resolve_redirects(redirects(spark, sf_dir)))


@query("repair_relations", f"{REPAIR_SQL} SELECT src, rel, dst, CASE WHEN action <> 'removed' THEN target END AS new_dst, action FROM z")
def repair_relations(spark, sf_dir):
    return repaired(spark, sf_dir)


@query("repair_bounded", f"""{REPAIR_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY action = 'kept' ORDER BY src, rel, dst) AS n FROM z)
 SELECT src, rel, dst, CASE WHEN action = 'kept' OR n > 200 THEN dst WHEN action = 'retargeted' THEN target END AS new_dst, CASE WHEN action <> 'kept' AND n > 200 THEN 'later' ELSE action END AS action FROM n""")
def repair_bounded(spark, sf_dir):
    return graph.first_fixes(repaired(spark, sf_dir))


@query("find_orphans", f"WITH {GRAPH_SQL} SELECT path FROM entities WHERE path NOT IN (SELECT entity FROM mentions) AND path NOT IN (SELECT src FROM edges) AND path NOT IN (SELECT dst FROM edges)")
def find_orphans(spark, sf_dir):
    return graph.orphans(entities(spark, sf_dir), mentions(spark, sf_dir), edges(spark, sf_dir)).select("path")


@query("orphaned_mentions", "SELECT 'P/' || l_partkey AS entity, 'O/' || l_orderkey AS note FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphaned_mentions(spark, sf_dir):
    live = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("O/"), F.col("o_orderkey").cast("string")).alias("path"))
    return graph.orphaned_mentions(mentions(spark, sf_dir), live)


RETRACT_SQL = f"WITH {GRAPH_SQL}, gone AS (SELECT 'O/' || o_orderkey AS note, row_number() OVER (ORDER BY 'O/' || o_orderkey) AS n FROM orders WHERE o_orderkey % 3 = 0), first AS (SELECT note FROM gone WHERE n <= 100)"


def retracted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("O/"), F.col("o_orderkey").cast("string")).alias("path"))
    return graph.retract_deleted(mentions(spark, sf_dir), o.filter("o_orderkey % 2 = 0").select("path"), o.filter("o_orderkey % 2 = 1 OR o_orderkey % 6 = 0").select("path"), o.filter("o_orderkey % 3 <> 0"))


@query("retract_deleted", f"{RETRACT_SQL} SELECT entity, count(*) AS n FROM mentions WHERE note NOT IN (SELECT note FROM first) GROUP BY entity")
def retract_deleted(spark, sf_dir):
    return retracted(spark, sf_dir)[0].groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("retract_manifest", f"""{RETRACT_SQL}, t AS (SELECT 'O/' || o_orderkey AS path, o_orderkey AS k FROM orders)
 SELECT 'hash' AS kind, path FROM t WHERE k % 2 = 0 AND path NOT IN (SELECT note FROM first) UNION ALL SELECT 'failure', path FROM t WHERE (k % 2 = 1 OR k % 6 = 0) AND path NOT IN (SELECT note FROM first)""")
def retract_manifest(spark, sf_dir):
    _, hashes, failures, _ = retracted(spark, sf_dir)
    return hashes.select(F.lit("hash").alias("kind"), "path").unionByName(failures.select(F.lit("failure").alias("kind"), "path"))


@query("retract_counts", f"{RETRACT_SQL} SELECT (SELECT count(*) FROM first) AS retracted_notes, (SELECT count(*) FROM mentions WHERE note IN (SELECT note FROM first)) AS removed_mentions, greatest((SELECT count(*) FROM gone) - 100, 0) AS remaining")
def retract_counts(spark, sf_dir):
    return retracted(spark, sf_dir)[3]


MERGE_SQL = f"""WITH {GRAPH_SQL}, g AS (SELECT 'P/' || p_partkey AS dup, 'P/' || (p_partkey - p_partkey % 4) AS canonical FROM part WHERE p_partkey % 4 <> 0),
 al AS (SELECT coalesce(g.canonical, e.path) AS path, unnest(CASE WHEN g.canonical IS NULL THEN aliases ELSE list_append(aliases, name) END) AS alias FROM entities e LEFT JOIN g ON g.dup = e.path),
 mm AS (SELECT DISTINCT coalesce(g.canonical, m.entity) AS entity, note FROM mentions m LEFT JOIN g ON g.dup = m.entity)"""


def merged(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P/"), c.cast("string"))
    merges = table(spark, sf_dir, "part").filter(k % 4 != 0).select(name(k).alias("dup"), name(k - k % 4).alias("canonical"))
    return graph.merge_entities(entities(spark, sf_dir), mentions(spark, sf_dir), edges(spark, sf_dir), merges)


@query("merge_entities", f"""{MERGE_SQL}, n AS (SELECT entity, count(*) AS n FROM mm GROUP BY entity), aa AS (SELECT path, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases FROM al GROUP BY path)
 SELECT e.path, aa.aliases, coalesce(n.n, 0) AS n_mentions FROM entities e JOIN aa USING (path) LEFT JOIN n ON n.entity = e.path WHERE e.path NOT IN (SELECT dup FROM g)""")
def merge_entities(spark, sf_dir):
    kept, moved, _ = merged(spark, sf_dir)
    counts = moved.groupBy(F.col("entity").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return kept.join(counts, "path", "left").select("path", F.array_join("aliases", ",").alias("aliases"), F.coalesce("n", F.lit(0)).alias("n_mentions"))


@query("merge_relations", f"{MERGE_SQL} SELECT DISTINCT coalesce(g.canonical, src) AS src, rel, dst FROM edges LEFT JOIN g ON g.dup = src")
def merge_relations(spark, sf_dir):
    return merged(spark, sf_dir)[2]


THRESHOLD = 0.3
SLICE_SQL = "sl AS (SELECT vec_id, vec_id::VARCHAR AS path, label, embedding::DOUBLE[] AS v FROM embeddings ORDER BY (vec_id % 3 = 0), (vec_id % 3 = 0 AND path <= '2'), path LIMIT 200)"
PAIRS_SQL = f"""{SLICE_SQL}, near AS (SELECT s.path AS p, e.vec_id::VARCHAR AS q, list_cosine_similarity(s.v, e.embedding::DOUBLE[]) AS cos FROM sl s JOIN embeddings e ON e.label = s.label AND e.vec_id <> s.vec_id),
 top AS (SELECT p, q FROM near WHERE cos >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY p ORDER BY cos DESC, q DESC) <= 5), pairs AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM top)"""


def part_slice(spark, sf_dir):
    return blocking.select_slice(vectors(spark, sf_dir).withColumn("checked", F.col("id") % 3 == 0), cursor="2")


def pairs_of(spark, sf_dir):
    return blocking.knn_pairs(vectors(spark, sf_dir), part_slice(spark, sf_dir), THRESHOLD)


@query("select_slice", f"WITH {SLICE_SQL} SELECT path FROM sl")
def select_slice(spark, sf_dir):
    return part_slice(spark, sf_dir)


@query("knn_pairs", f"WITH {PAIRS_SQL} SELECT a, b FROM pairs")
def knn_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir)


COMP_SQL = f"""WITH RECURSIVE {PAIRS_SQL}, sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), walk AS (SELECT a AS node, a AS here FROM sym UNION SELECT w.node, sym.b FROM walk w JOIN sym ON sym.a = w.here),
 comp AS (SELECT node AS path, min(here) AS component FROM walk GROUP BY node)"""


@query("clusters", f"{COMP_SQL} SELECT path, component FROM comp")
def clusters(spark, sf_dir):
    return graph.components(pairs_of(spark, sf_dir)).select(F.col("node").alias("path"), "component")


@query("balanced_split", """WITH m AS (SELECT label, vec_id::VARCHAR AS path, row_number() OVER (PARTITION BY label ORDER BY vec_id::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
 k AS (SELECT *, n // ceil(n / 10.0)::BIGINT AS base, n % ceil(n / 10.0)::BIGINT AS extra FROM m)
 SELECT path, (CASE WHEN i < extra * (base + 1) THEN i // (base + 1) ELSE extra + (i - extra * (base + 1)) // base END)::INTEGER AS chunk FROM k""")
def balanced_split(spark, sf_dir):
    return blocking.balanced_chunks(vectors(spark, sf_dir).select("folder", "path"), "folder").select("path", "chunk")


@query("batch_pack", """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY source) AS seq, count(*) AS size FROM documents GROUP BY source),
 f AS (SELECT seq, size, 0 AS batch, size AS run FROM s WHERE seq = 1 UNION ALL SELECT s.seq, s.size, CASE WHEN run + s.size > 120 THEN batch + 1 ELSE batch END, CASE WHEN run + s.size > 120 THEN s.size ELSE run + s.size END FROM f JOIN s ON s.seq = f.seq + 1)
 SELECT seq, size, batch FROM f""")
def batch_pack(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    return blocking.pack_batches(counts.withColumn("seq", F.row_number().over(Window.orderBy("source"))), most=120)


VOTE_SQL = """near AS (SELECT c.vec_id AS p, e.vec_id::VARCHAR AS q, e.label, list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM embeddings c, embeddings e WHERE c.vec_id <> e.vec_id),
 top AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY sim DESC, q) AS place FROM near WHERE sim > 0 QUALIFY place <= 10),
 v AS (SELECT p, label, sum(sim) AS mass, min(place) AS first FROM top GROUP BY p, label),
 votes AS (SELECT p::VARCHAR AS path, label::VARCHAR AS folder, mass / sum(mass) OVER (PARTITION BY p) AS share FROM v QUALIFY row_number() OVER (PARTITION BY p ORDER BY round(mass, 9) DESC, first) = 1)"""


def votes_of(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return organize.folder_vote(v, v)


@query("folder_vote", f"WITH {VOTE_SQL} SELECT path, folder, round(share, 6) AS share FROM votes")
def folder_vote(spark, sf_dir):
    return votes_of(spark, sf_dir).select("path", "folder", F.round("share", 6).alias("share"))


@query("organize_decisions", f"""WITH {VOTE_SQL}, c AS (SELECT vec_id::VARCHAR AS path, CASE WHEN vec_id % 20 = 0 THEN label::VARCHAR END AS current, vec_id % 30 = 0 AS dup FROM embeddings)
 SELECT path, folder, round(share, 6) AS share, CASE WHEN folder IS NULL OR folder IS NOT DISTINCT FROM current THEN 'skip' WHEN share < 0.3 THEN CASE WHEN current IS NULL THEN 'propose' ELSE 'skip' END WHEN dup THEN 'propose' ELSE 'move' END AS action FROM c LEFT JOIN votes USING (path)""")
def organize_decisions(spark, sf_dir):
    c = vectors(spark, sf_dir).select("path", F.col("path").alias("stem"), F.when(F.col("id") % 20 == 0, F.col("folder")).alias("current"), "id")
    done = organize.decisions(c.drop("id"), votes_of(spark, sf_dir), c.filter("id % 30 = 0").select("stem"), 0.3)
    return done.withColumn("share", F.round("share", 6))


@query("undo_latest_move", "SELECT user_id, event_id FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def undo_latest_move(spark, sf_dir):
    journal = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("to"), (F.col("event_type") == "error").alias("undone"))
    return organize.latest_move(journal).select(F.col("to").alias("user_id"), F.col("seq").alias("event_id"))


CHANGED_SQL = f"WITH {NOTES_SQL}, cur AS (SELECT doc_id, path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM notes WHERE doc_id % 11 <> 0), man AS (SELECT doc_id, path, sha256(text) AS hash FROM notes WHERE doc_id % 5 <> 0)"


def snapshots(spark, sf_dir):
    n = notes(spark, sf_dir)
    changed = n.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return index.hashes(changed), index.hashes(n.filter("doc_id % 5 <> 0")), n


@query("content_hash_diff", f"WITH {NOTES_SQL} SELECT path, sha256(text) AS hash FROM notes")
def content_hash_diff(spark, sf_dir):
    return index.hashes(notes(spark, sf_dir))


@query("manifest_drift", f"{CHANGED_SQL} SELECT coalesce(m.path, c.path) AS path, CASE WHEN m.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN m.hash <> c.hash THEN 'changed' ELSE 'same' END AS state FROM man m FULL JOIN cur c ON m.path = c.path")
def manifest_drift(spark, sf_dir):
    current, manifest, _ = snapshots(spark, sf_dir)
    return index.drift(manifest, current)


@query("pending_index", f"{CHANGED_SQL} SELECT c.path FROM cur c LEFT JOIN man m ON m.path = c.path WHERE (m.hash IS DISTINCT FROM c.hash OR c.doc_id % 13 = 0) AND NOT (c.doc_id % 13 = 0 AND c.doc_id % 4 >= 3)")
def pending_index(spark, sf_dir):
    current, manifest, n = snapshots(spark, sf_dir)
    return index.pending(current, manifest, n.filter("doc_id % 13 = 0").select("path", (F.col("doc_id") % 4).alias("attempts")))


@query("stale_vectors", f"{CHANGED_SQL} SELECT path FROM cur WHERE doc_id % 2 = 1 AND (path, hash) NOT IN (SELECT (path, hash) FROM man)")
def stale_vectors(spark, sf_dir):
    current, manifest, n = snapshots(spark, sf_dir)
    return index.stale_vectors(current, n.select("path", (F.col("doc_id") % 2 == 0).alias("fresh")), manifest).select("path")


@query("config_drift", "SELECT coalesce(w.n_name, i.n_name) AS name, CASE WHEN i.n_name IS NULL THEN 'missing' WHEN w.n_name IS NULL THEN 'extra' WHEN w.n_regionkey = i.v THEN 'present' ELSE 'drifted' END AS state FROM (SELECT * FROM nation WHERE n_nationkey < 20) w FULL JOIN (SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey > 4) i ON w.n_name = i.n_name")
def config_drift(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    wanted = n.filter("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("value"))
    installed = n.filter("n_nationkey > 4").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 == 0, -1).otherwise(F.col("n_regionkey")).alias("value"))
    return index.config_drift(wanted, installed)


CUSTOMERS = sheets.Sheet({"segment": sheets.Field("enum", True, ("BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE")), "balance": sheets.Field("number"), "name": sheets.Field("string", max_length=18), "nation": sheets.Field("string")}, key=("segment", "nation"), identity=("name",))
ORDERS = sheets.Sheet({"status": sheets.Field("string"), "total": sheets.Field("number"), "date": sheets.Field("date"), "priority": sheets.Field("string")})
SHEET_SQL = "sheet AS (SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS path, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS total, o_orderdate AS date, o_orderpriority AS priority FROM orders)"


def order_sheet(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "").when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(F.lpad(k.cast("string"), 9, "0").alias("path"), status.alias("status"), F.when(k % 13 != 0, F.col("o_totalprice")).alias("total"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"))


def sheet_query(name, filters, where, sort=None, descending=False, limit=None):
    order = f" ORDER BY ({sort} IS NULL), {sort} {'DESC' if descending else 'ASC'}, path LIMIT {limit}" if sort else ""
    query(f"sheet_query_{name}", f"WITH {SHEET_SQL} SELECT path, status, total FROM sheet WHERE {where}{order}")(
        lambda spark, sf_dir: sheets.query(order_sheet(spark, sf_dir), ORDERS, filters, sort, descending, limit=limit).select("path", "status", "total")
    )


sheet_query("eq", {"status": {"eq": "O"}}, "status = 'O'")
sheet_query("ne", {"status": {"ne": "O"}}, "coalesce(status, '') = '' OR status <> 'O'")
sheet_query("range", {"total": {"gt": 100000, "lte": 200000}, "date": {"gte": "1996-01-01", "lt": "1998-01-01"}}, "total > 100000 AND total <= 200000 AND date >= '1996-01-01' AND date < '1998-01-01'")
sheet_query("in", {"status": {"in": ["O", "P"]}}, "status IN ('O', 'P')")
sheet_query("nin", {"status": {"nin": ["O", "P"]}}, "coalesce(status, '') = '' OR status NOT IN ('O', 'P')")
sheet_query("contains", {"priority": {"contains": "urg"}}, "contains(lower(priority), 'urg')")
sheet_query("missing", {"status": {"missing": True}}, "coalesce(status, '') = ''")
sheet_query("sort", {"status": {"missing": False}}, "coalesce(status, '') <> ''", "total", True, 40)
sheet_query("followups_due", {"date": {"lte": "1995-06-30"}, "status": {"nin": ["F"]}}, "date < '1995-07-01' AND (coalesce(status, '') = '' OR status <> 'F')")


def customer_sheet(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.lpad(k.cast("string"), 7, "0").alias("path"), F.when(k % 17 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 19 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(k % 23 == 0, F.concat("c_name", F.lit("#"))).otherwise(F.col("c_name")).alias("name"), F.col("c_nationkey").cast("string").alias("nation"))


CUSTOMER_SQL = "cs AS (SELECT lpad(c_custkey::VARCHAR, 7, '0') AS path, CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS segment, c_custkey % 19 = 0 AS nan, c_custkey % 23 = 0 AS long, c_name, c_nationkey FROM customer)"


@query("sheet_check", f"""WITH {CUSTOMER_SQL}, e AS (SELECT path, CASE WHEN segment NOT IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE') THEN 'segment: not a enum' WHEN nan THEN 'balance: not a number' WHEN long THEN 'name: longer than 18' WHEN segment IS NULL THEN 'segment: missing' END AS error FROM cs)
 SELECT path, error FROM e WHERE error IS NOT NULL""")
def sheet_check(spark, sf_dir):
    return sheets.check(customer_sheet(spark, sf_dir), CUSTOMERS)


@query("sheet_duplicates", f"WITH {CUSTOMER_SQL}, k AS (SELECT path, min(path) OVER (PARTITION BY coalesce(lower(segment), ''), c_nationkey) AS first_path FROM cs WHERE segment IS NOT NULL) SELECT first_path, path FROM k WHERE path <> first_path")
def sheet_duplicates(spark, sf_dir):
    return sheets.duplicates(customer_sheet(spark, sf_dir).filter("segment IS NOT NULL"), ["segment", "nation"])


UPSERT_SQL = """b AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 7, '0') AS path, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, CASE WHEN k % 5 = 0 THEN -1e9 WHEN k % 7 <> 0 THEN c_acctbal END AS balance, c_acctbal, c_name,
   CASE WHEN k % 2 = 0 THEN c_name || ' new' WHEN k % 11 = 0 THEN c_name ELSE '  ' || upper(c_name) END AS name FROM customer WHERE c_custkey % 3 = 0),
 u AS (SELECT *, concat_ws(',', CASE WHEN balance IS DISTINCT FROM c_acctbal THEN 'balance' END, CASE WHEN name <> c_name THEN 'name' END) AS changed FROM b)"""


def customer_batch(spark, sf_dir):
    """A sheet of the customers with odd keys, and a batch that updates, clears, repeats and adds some."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(k.cast("string"), 7, "0").alias("path"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    balance = F.when(k % 5 == 0, F.lit(-1e9)).when(k % 7 != 0, F.col("balance"))
    name = F.when(k % 2 == 0, F.concat("name", F.lit(" new"))).when(k % 11 == 0, F.col("name")).otherwise(F.concat(F.lit("  "), F.upper("name")))
    batch = rows.filter("c_custkey % 3 = 0").withColumn("balance", balance).withColumn("name", name)
    return rows.filter("c_custkey % 2 = 1").drop("c_custkey"), batch.withColumnRenamed("c_custkey", "seq").drop("path")


@query("upsert_sheet", f"WITH {UPSERT_SQL} SELECT k AS seq, CASE WHEN k % 2 = 1 THEN path END AS path, CASE WHEN k % 2 = 0 THEN 'insert' WHEN changed = '' THEN 'none' ELSE 'update' END AS action, CASE WHEN k % 2 = 1 AND changed <> '' THEN changed END AS changed FROM u")
def upsert_sheet(spark, sf_dir):
    return sheets.upsert(*customer_batch(spark, sf_dir), CUSTOMERS)


WIDE_CUSTOMERS = sheets.Sheet({**CUSTOMERS.fields, "name": sheets.Field("string", max_length=22)}, CUSTOMERS.key, CUSTOMERS.identity, "customers", "Sheets/Customers", "{name} - {nation}")


@query("upsert_merged", f"""WITH {UPSERT_SQL}, old AS (SELECT c.c_custkey AS k, lpad(c.c_custkey::VARCHAR, 7, '0') AS path, c.c_mktsegment AS segment, c.c_nationkey::VARCHAR AS nation, c.c_acctbal AS balance, c.c_name AS name FROM customer c WHERE c.c_custkey % 2 = 1)
 SELECT o.path, coalesce(u.segment, o.segment) AS segment, coalesce(u.nation, o.nation) AS nation, CASE WHEN u.k IS NULL THEN o.balance ELSE u.balance END AS balance, coalesce(u.name, o.name) AS name, CASE WHEN u.changed <> '' THEN 'a' END AS agent FROM old o LEFT JOIN u ON u.k = o.k AND length(u.name) <= 22 AND u.segment <> 'MACHINERY'
 UNION ALL SELECT 'Sheets/Customers/' || name || ' - ' || nation || '.md', segment, nation, balance, name, 'a' FROM u WHERE k % 2 = 0 AND length(name) <= 22 AND segment <> 'MACHINERY'""")
def upsert_merged(spark, sf_dir):
    base, batch = customer_batch(spark, sf_dir)
    done = sheets.upsert(base, batch, WIDE_CUSTOMERS)
    return sheets.merged(base, batch, done, WIDE_CUSTOMERS, "2024-01-01 10:00", "a").drop("created")


@query("recent_by_folder", "SELECT event_type AS folder, count(*) AS n, max(ts) AS latest FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type")
def recent_by_folder(spark, sf_dir):
    recent = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return recent.groupBy(F.col("event_type").alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


SHEET_FAULTS_SQL = "SELECT count(*) FROM customer WHERE c_custkey % 17 = 0 OR c_custkey % 19 = 0 OR c_custkey % 23 = 0 OR c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE')"
HEALTH_SQL = f"""{CHANGED_SQL} SELECT (SELECT count(*) FROM cur WHERE doc_id % 2 = 1 AND (path, hash) NOT IN (SELECT (path, hash) FROM man)) AS stale_embeddings,
 (SELECT count(*) FROM man m FULL JOIN cur c ON m.path = c.path WHERE m.path IS NULL OR c.path IS NULL) AS manifest_drift, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)) AS orphaned_entities,
 (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) AS cache_consistency, (SELECT count(*) FROM embeddings WHERE vec_id % 4 = 0) + 2 AS pending_proposals, ({SHEET_FAULTS_SQL}) AS invalid_sheet_rows,
 (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 500 = 1) AND p_partkey % 5 = 0) AS pending_retirements, 1 AS sweep_errors"""


@query("health_report", HEALTH_SQL)
def health_report(spark, sf_dir):
    """All metrics, over notes, a graph, sheets and a sweep that have faults: each order of 97 is gone, each part of 50 is not
    in the cache, each vector of 4 waits to be filed, beside two merges, and one step of the sweep has failed."""
    known = table(spark, sf_dir, "orders").filter("o_orderkey % 97 <> 0").select(F.concat(F.lit("O/"), F.col("o_orderkey").cast("string")).alias("path"))
    e = entities(spark, sf_dir)
    number = F.substring("path", 3, 20).cast("long")
    few = mentions(spark, sf_dir).filter(F.substring("note", 3, 20).cast("long") % 500 == 1)
    decided = vectors(spark, sf_dir).select("path", F.when(F.col("id") % 4 == 0, "propose").otherwise("skip").alias("action"))
    merges = spark.createDataFrame([("a",), ("b",)], "canonical string")
    steps = sweep.run({"index": lambda: {"processed": 3}, "organize": lambda: (_ for _ in ()).throw(OSError("disk"))})
    return health.report({
        "stale_embeddings": stale_vectors(spark, sf_dir), "manifest_drift": manifest_drift(spark, sf_dir).filter("state IN ('added', 'removed')"), "orphaned_entities": graph.orphaned_mentions(mentions(spark, sf_dir).distinct(), known),
        "cache_consistency": health.cache_faults(e.filter(number % 50 != 0), e), "pending_proposals": health.pending_proposals(decided, merges, merges.limit(0), True), "invalid_sheet_rows": sheets.check(customer_sheet(spark, sf_dir), CUSTOMERS),
        "pending_retirements": graph.retirements(e, few, edges(spark, sf_dir).limit(0), e.filter(number % 5 == 0)), "sweep_errors": sweep.errors(spark, steps),
    })
