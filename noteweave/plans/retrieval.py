"""Registered retrieval and note queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.functions import front
from noteweave.functions import text as tx
from noteweave.operators import notes as nt
from noteweave.operators import rank
from noteweave.plans.registry import query
from noteweave.plans.tables import MARKED_SQL, NOTES_SQL, block_notes, marked_notes, notes, table, vectors
from noteweave.sources import vault

WORDS = "the thing idiot"


def bm25_sql(where: str, terms: list[str] | None = None, by: str | None = None) -> str:
    terms = terms or WORDS.split()
    each = range(len(terms))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in each)
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN (ln(n + 1.0) - ln(df{i} + 0.5)) * tf{i} * 2.5 * (tf{i} / k + 0.5) / (2.0 + tf{i} / k) ELSE 0 END" for i in each)
    part, more = (f"PARTITION BY {by} ", f", {by}") if by else ("", "")
    return f"""bm AS (WITH tok AS (SELECT doc_id, path{more}, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM notes WHERE {where}),
      cnt AS (SELECT doc_id, path{more}, len(t) AS dl, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM cnt),
      sc AS (SELECT doc_id, path{more}, {score} AS score FROM (SELECT *, 0.25 + 0.75 * dl / a AS k FROM cnt, st))
      SELECT doc_id, path{more}, score, row_number() OVER ({part}ORDER BY round(score, 9) DESC, string_split(path, '/')) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 50)"""


@query("bm25_search", f"WITH {NOTES_SQL}, {bm25_sql('true')} SELECT path, round(score, 6) AS score, rank::INTEGER AS rank FROM bm")
def bm25_search(spark, sf_dir):
    return rank.bm25l(notes(spark, sf_dir), WORDS).select("path", F.round("score", 6).alias("score"), "rank")


FILTERED = "lang = 'en' AND path LIKE 'src1/%'"


@query("bm25_filtered", f"WITH {NOTES_SQL}, {bm25_sql(FILTERED)} SELECT path, round(score, 6) AS score, rank::INTEGER AS rank FROM bm")
def bm25_filtered(spark, sf_dir):
    kept = nt.in_folder(notes(spark, sf_dir).filter(F.col("lang") == "en"), "src1")
    return rank.bm25l(kept, WORDS).select("path", F.round("score", 6).alias("score"), "rank")


@query("tokenize_terms", "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, sf_dir):
    per_doc = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


SUB_SQL = "sub AS (SELECT doc_id, path, row_number() OVER (ORDER BY path) AS rank FROM notes WHERE contains(lower(parse_filename(path, true)), 'idiot') OR len(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: contains(lower(x), 'idiot'))) > 0 QUALIFY rank <= 50)"


@query("substring_search", f"WITH {NOTES_SQL}, {SUB_SQL} SELECT path, rank::INTEGER AS rank FROM sub")
def substring_search(spark, sf_dir):
    return rank.substring_rank(notes(spark, sf_dir), "IDIOT").select("path", "rank")


@query("title_search", f"WITH {NOTES_SQL} SELECT path FROM notes WHERE contains(doc_id::VARCHAR, '77') ORDER BY string_split(path, '/') LIMIT 20")
def title_search(spark, sf_dir):
    return nt.title_search(notes(spark, sf_dir), "77", 20).select("path")


@query("substring_fallback_gate", f"WITH {NOTES_SQL} SELECT path, row_number() OVER (ORDER BY path)::INTEGER AS rank FROM notes WHERE contains(lower(text), 'idio') QUALIFY rank <= 50")
def substring_fallback_gate(spark, sf_dir):
    n = notes(spark, sf_dir)
    return rank.gated(rank.substring_rank(n, "idio"), rank.bm25l(n, "idio")).select("path", "rank")


VEC_SQL = "vr AS (SELECT e.vec_id::VARCHAR AS path, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE score > 0 QUALIFY rank <= 50)"


@query("vector_topk", f"WITH {VEC_SQL} SELECT path, round(score, 6) AS score, rank::INTEGER AS rank FROM vr")
def vector_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rank.vector_rank(v.select("path", "vec"), v.filter("id = 0").select(F.col("vec").alias("qvec"))).select("path", F.round("score", 6).alias("score"), "rank")


RRF_SQL = f"WITH {NOTES_SQL}, {bm25_sql('true')}, {VEC_SQL}, every AS (SELECT doc_id::VARCHAR AS path, rank, 0 AS l FROM bm UNION ALL SELECT path, rank, 1 FROM vr), fused AS (SELECT path, sum(1.0 / (60 + rank)) AS score, min((l, rank)) AS first FROM every GROUP BY path)"


def lanes(spark, sf_dir):
    """documents as notes under their numbers, and their vectors."""
    by_id = notes(spark, sf_dir).withColumn("full", F.col("path")).withColumn("path", F.col("doc_id").cast("string"))
    v = vectors(spark, sf_dir).select("path", "vec")
    return by_id, v, v.filter("path = '0'").select(F.col("vec").alias("qvec"))


@query("rrf_fuse", f"{RRF_SQL} SELECT path, round(score, 9) AS score FROM fused")
def rrf_fuse(spark, sf_dir):
    by_id, v, asked = lanes(spark, sf_dir)
    return rank.rrf([rank.bm25l(by_id, WORDS, tie="full"), rank.vector_rank(v, asked)]).select("path", F.round("score", 9).alias("score"))


BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def excerpt_sql(words: str) -> str:
    lines = f"list_transform(regexp_split_to_array(n.text, '{BREAKS}'), lambda x: trim(x))"
    return f"CASE WHEN contains(b.path, '{words}') THEN '(title match)' ELSE coalesce(list_filter({lines}, lambda x: contains(lower(x), '{words}'))[1], list_filter({lines}, lambda x: x <> '')[1][:120], '') END"


NOTE_VEC_SQL = VEC_SQL.replace("FROM embeddings e,", "FROM embeddings e JOIN documents ON doc_id = vec_id,")
NOTE_RRF_SQL = RRF_SQL.replace(VEC_SQL, NOTE_VEC_SQL)


@query("hybrid_search", f"{NOTE_RRF_SQL}, best AS (SELECT path, row_number() OVER (ORDER BY round(score, 12) DESC, first) AS rank FROM fused QUALIFY rank <= 20) SELECT b.rank::INTEGER AS rank, b.path, {excerpt_sql(WORDS)} AS excerpt FROM best b JOIN notes n ON n.doc_id::VARCHAR = b.path")
def hybrid_search(spark, sf_dir):
    return rank.hybrid(*lanes(spark, sf_dir)[:2], WORDS, lanes(spark, sf_dir)[2], 20, tie="full")


@query("hybrid_fallback", f"""WITH {NOTES_SQL}, {NOTE_VEC_SQL}, sub AS (SELECT doc_id::VARCHAR AS path, row_number() OVER (ORDER BY doc_id::VARCHAR) AS rank FROM notes WHERE contains(lower(text), 'idio') OR contains(doc_id::VARCHAR, 'idio') QUALIFY rank <= 50),
 fused AS (SELECT path, sum(1.0 / (60 + rank)) AS score, min((l, rank)) AS first FROM (SELECT path, rank, 1 AS l FROM vr UNION ALL SELECT path, rank, 2 FROM sub) GROUP BY path),
 best AS (SELECT path, row_number() OVER (ORDER BY round(score, 12) DESC, first) AS rank FROM fused QUALIFY rank <= 15) SELECT b.rank::INTEGER AS rank, b.path, {excerpt_sql('idio')} AS excerpt FROM best b JOIN notes n ON n.doc_id::VARCHAR = b.path""")
def hybrid_fallback(spark, sf_dir):
    by_id, v, asked = lanes(spark, sf_dir)
    return rank.hybrid(by_id, v, "idio", asked, 15)


@query("search_lines", f"""WITH {NOTES_SQL}, l AS (SELECT path, doc_id, unnest(regexp_split_to_array(text, '{BREAKS}')) AS line, generate_subscripts(regexp_split_to_array(text, '{BREAKS}'), 1) AS number FROM notes)
 SELECT path, number::INTEGER AS number, line FROM (SELECT path, number, trim(line) AS line FROM l WHERE contains(lower(line), '7') UNION ALL SELECT path, 0, '(title match)' FROM notes WHERE contains(doc_id::VARCHAR, '7')) ORDER BY string_split(path, '/'), number LIMIT 30""")
def search_lines(spark, sf_dir):
    return nt.search_lines(notes(spark, sf_dir), "7", 30)


@query("excerpt_first_match", f"WITH {MARKED_SQL} SELECT path, coalesce(list_filter(l, lambda x: contains(lower(x), 'idiot'))[1], list_filter(l, lambda x: x <> '')[1][:120], '') AS excerpt FROM (SELECT path, list_transform(string_split(substr(text, instr(substr(text, 4), chr(10) || '---') + 7), chr(10)), lambda x: trim(x)) AS l FROM notes)")
def excerpt_first_match(spark, sf_dir):
    return marked_notes(spark, sf_dir).select("path", tx.excerpt(F.col("text"), F.col("path"), "Idiot").alias("excerpt"))


@query("frontmatter_body", f"WITH {MARKED_SQL} SELECT path, '[' || lang || ', T' || (doc_id % 3) || ']' AS tags, source AS project, md5(substr(text, instr(substr(text, 4), chr(10) || '---') + 7)) AS body_md5, 'Doc ' || doc_id AS title FROM notes")
def frontmatter_body(spark, sf_dir):
    t = F.col("text")
    return marked_notes(spark, sf_dir).select("path", F.concat(F.lit("["), F.array_join(tx.front_list(t, "tags"), ", "), F.lit("]")).alias("tags"), tx.front_value(t, "project").alias("project"), F.md5(tx.body(t).cast("binary")).alias("body_md5"), tx.heading(t, F.col("path")).alias("title"))


@query("tag_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 3 = 1")
def tag_filter(spark, sf_dir):
    return nt.with_tags(marked_notes(spark, sf_dir), ["EN", "t1"]).select("doc_id")


@query("tag_filter_block", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 3 = 1")
def tag_filter_block(spark, sf_dir):
    return nt.with_tags(block_notes(spark, sf_dir), ["EN", "t1"]).select("doc_id")


@query("project_filter", "SELECT doc_id FROM documents WHERE source = 'src3'")
def project_filter(spark, sf_dir):
    return nt.query_notes(block_notes(spark, sf_dir), project="SRC3: X").select("doc_id")


@query("yaml_metadata", "SELECT doc_id, lang || ',T' || (doc_id % 3) AS tags, source || ': x' AS project, 'o' || (doc_id % 7) AS owner, doc_id % 2 = 0 AS active, 'a' || (doc_id % 5) || '|b, c' AS aliases, 'folded text ' || doc_id AS note FROM documents")
def yaml_metadata(spark, sf_dir):
    n = block_notes(spark, sf_dir).withColumn("m", front.meta(F.col("text")))
    m = F.col("m")
    return n.select("doc_id", F.array_join(front.values(m, "tags"), ",").alias("tags"), front.value(m, "project").alias("project"), front.value(m, "owner.name").alias("owner"), F.try_variant_get(m, "$.owner.active", "boolean").alias("active"), F.array_join(front.values(m, "aliases"), "|").alias("aliases"), F.rtrim(F.regexp_replace(front.value(m, "note"), "\n", "")).alias("note"))


@query("folder_filter", f"WITH {NOTES_SQL} SELECT doc_id, path FROM notes WHERE path LIKE 'src1/de/%'")
def folder_filter(spark, sf_dir):
    return nt.in_folder(notes(spark, sf_dir), "src1/de").select("doc_id", "path")


@query("query_notes", f"WITH {NOTES_SQL} SELECT path, lang FROM notes WHERE doc_id % 3 = 2 AND source = 'src3'")
def query_notes(spark, sf_dir):
    return nt.query_notes(marked_notes(spark, sf_dir), tags=["t2"], project="SRC3").select("path", "lang")


@query("backlinks", f"WITH {NOTES_SQL} SELECT path FROM notes WHERE doc_id % 50 = 7 AND doc_id <> 7")
def backlinks(spark, sf_dir):
    target = "src7/en/7.md"
    found = nt.backlinks(marked_notes(spark, sf_dir), target)
    return found.filter(F.col("doc_id") != 7).select("path")


@query("list_tasks", f"WITH {NOTES_SQL} SELECT path, doc_id % 2 = 0 AS done, 'review [[src/' || source || '|s]]' AS task FROM notes")
def list_tasks(spark, sf_dir):
    return nt.list_tasks(marked_notes(spark, sf_dir))


@query("list_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def list_recent(spark, sf_dir):
    return nt.list_recent(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 25)


@query("digest_since", "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def digest_since(spark, sf_dir):
    changed = nt.since_days(table(spark, sf_dir, "events"), "ts", 7)
    return changed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("recent_inbox", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND event_type = 'click' ORDER BY minute DESC, event_id LIMIT 40")
def recent_inbox(spark, sf_dir):
    ev = table(spark, sf_dir, "events").filter((F.col("ts") >= F.lit("2024-01-02").cast("timestamp")) & (F.col("event_type") == "click"))
    minute = F.date_format("ts", "yyyy-MM-dd HH:mm")
    return ev.select("event_id", minute.alias("minute")).orderBy(F.desc("minute"), "event_id").limit(40)


@query("resume_sessions", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g'))[:400] AS excerpt FROM conversations WHERE role = 'user' AND contains(lower(text), 'thing') ORDER BY conv_id DESC, turn LIMIT 10")
def resume_sessions(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").filter((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("thing")))
    return conv.orderBy(F.desc("conv_id"), "turn").limit(10).select("conv_id", "turn", tx.body_excerpt(F.col("text")).alias("excerpt"))


LINK_SQL = """WITH u AS (SELECT page_id, split_part(trim(url), '#', 1) AS nf FROM pages),
 p AS (SELECT page_id, split_part(nf, '?', 1) AS base, CASE WHEN contains(nf, '?') THEN substr(nf, instr(nf, '?') + 1) ELSE '' END AS q FROM u),
 s AS (SELECT page_id, lower(regexp_extract(base, '^([^:/]+://[^/]*)', 1)) AS head, rtrim(regexp_replace(base, '^[^:/]+://[^/]*', ''), '/') AS path,
   array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_.*|ref|src|gh_src|lever-origin)$'))), '&') AS params FROM p)
 SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN params = '' THEN '' ELSE '?' || params END AS link FROM s"""


@query("normalize_links", LINK_SQL)
def normalize_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.normalize_link(F.col("url")).alias("link"))


@query("duplicate_stems", "SELECT lower(name) AS stem, count(*) AS n FROM (SELECT p_name AS name FROM part) GROUP BY 1 HAVING count(*) > 1")
def duplicate_stems(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("x/"), F.col("p_name"), F.lit(".md")).alias("path"))
    return nt.duplicate_stems(paths)


@query("tool_use_count", """SELECT conv_id::VARCHAR AS file, sum(CASE WHEN turn % 7 = 6 OR role = 'user' THEN 0 WHEN turn % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS tools, coalesce(bool_or(turn % 7 <> 6 AND role <> 'user' AND turn % 3 = 0 AND conv_id % 2 = 0), false) AS logged FROM conversations GROUP BY conv_id""")
def tool_use_count(spark, sf_dir):
    """conversations as transcripts: turns of others than the user have blocks of tools, some of them two, in a message or in
    the line itself; each seventh line is cut off, the user's turns are plain text."""
    turn = F.col("turn")
    use = lambda name: F.struct(F.lit("tool_use").alias("type"), name.alias("name"))
    log = F.when(F.col("conv_id") % 2 == 0, F.lit("mcp__notes__log_session")).otherwise(F.lit("open"))
    blocks = F.when(turn % 3 == 0, F.array(use(log), use(F.lit("read")))).otherwise(F.array(use(F.lit("read")), F.struct(F.lit("text").alias("type"), F.lit("log_session").alias("name"))))
    inner = F.to_json(F.struct(blocks.alias("content")))
    line = F.when(F.col("role") == "user", F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))).when(turn % 2 == 0, inner).otherwise(F.concat(F.lit('{"message":'), inner, F.lit("}")))
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.when(turn % 7 == 6, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    return vault.tool_uses(lines)


EVAL_SQL = f"""WITH {NOTES_SQL}, {bm25_sql('true', by='source')}, hits AS (SELECT source, doc_id, rank FROM bm),
 gold AS (SELECT source, doc_id, quality = 1 AS expect, toxic = 1 AS accept FROM labels JOIN documents USING (doc_id) WHERE quality = 1 OR toxic = 1),
 j AS (SELECT g.source, g.expect, g.expect OR g.accept AS good, h.rank FROM gold g LEFT JOIN hits h ON h.source = g.source AND h.doc_id = g.doc_id)
 SELECT source, round(count(*) FILTER (expect AND rank <= 5) / count(*) FILTER (expect), 6) AS recall_5, max(CASE WHEN rank <= 5 AND good THEN 1 ELSE 0 END) AS success_5, min(CASE WHEN good THEN rank END) AS first_rank,
   round(coalesce(1.0 / min(CASE WHEN good THEN rank END), 0), 6) AS rr FROM j GROUP BY source HAVING count(*) FILTER (expect) > 0"""


@query("eval_metrics", EVAL_SQL)
def eval_metrics(spark, sf_dir):
    from noteweave.operators import evals

    n = notes(spark, sf_dir)
    hits = rank.bm25l(n, WORDS, by="source").select(F.col("source").alias("query"), F.col("doc_id").alias("item"), "rank")
    labels = table(spark, sf_dir, "labels").filter("quality = 1 OR toxic = 1")
    gold = labels.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("item"), (F.col("quality") == 1).alias("expect"))
    return evals.per_query(gold, hits, 5).select(F.col("query").alias("source"), F.round("recall", 6).alias("recall_5"), F.col("success").alias("success_5"), F.col("first_rank").cast("long").alias("first_rank"), F.round("rr", 6).alias("rr"))


@query("eval_summary", f"WITH m AS ({EVAL_SQL}) SELECT count(*) AS n, round(avg(recall_5), 5) AS recall_5, round(avg(success_5), 5) AS success_5, round(avg(rr), 5) AS mrr FROM m")
def eval_summary(spark, sf_dir):
    m = eval_metrics(spark, sf_dir)
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_5"), 5).alias("recall_5"), F.round(F.avg("success_5"), 5).alias("success_5"), F.round(F.avg("rr"), 5).alias("mrr"))
