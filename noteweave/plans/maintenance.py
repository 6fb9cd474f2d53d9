"""Registered maintenance and model-backed queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from noteweave.operators import plug, sweep
from noteweave.plans.registry import query
from noteweave.plans.tables import NOTES_SQL, notes, table


@query("sweep_counters", "SELECT event_type, sum(value) AS value, max_by(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def sweep_counters(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("round", F.col("event_id"))
    return sweep.counters(ev, ["value"], ["user_id"], "event_type")


@query("retained_reports", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 30")
def retained_reports(spark, sf_dir):
    return sweep.retained(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@query("heal_pending", f"WITH {NOTES_SQL}, o AS (SELECT path, 0 AS n, 100000 - doc_id AS seq FROM notes WHERE doc_id % 9 = 0 AND doc_id % 4 <> 0 UNION ALL SELECT path, 1, 0 FROM notes WHERE doc_id % 10 = 1 AND doc_id % 9 <> 0) SELECT path FROM o ORDER BY n, seq, path LIMIT 200")
def heal_pending(spark, sf_dir):
    n = notes(spark, sf_dir)
    return sweep.heal_pending(n.filter("doc_id % 9 = 0").select("path", (100000 - F.col("doc_id")).alias("seq")), n.filter("doc_id % 4 <> 0"), n.filter("doc_id % 10 = 1"))


@query("unique_proposals", "SELECT min(l_orderkey * 10 + l_linenumber) AS seq, lower(l_returnflag) AS type, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_partkey % 50")
def unique_proposals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("type"), (F.col("l_partkey") % 50).cast("string").alias("canonical"))
    li = li.withColumn("dups", F.when(F.col("seq") % 2 == 0, F.array(F.lit("X"), F.lit("y"))).otherwise(F.array(F.lit("Y"), F.lit("x"))))
    n = li.groupBy(F.lower("type").alias("t"), F.col("canonical").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    kept = sweep.unique_proposals(li)
    return kept.join(n, (F.lower("type") == F.col("t")) & (F.col("canonical") == F.col("c"))).select("seq", F.lower("type").alias("type"), "n")


@query("embed_missing", f"""WITH {NOTES_SQL}, w AS (SELECT path, doc_id, list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda x: sha256(x)[2:2]) AS h FROM notes)
 SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'plugin' WHEN doc_id % 5 = 0 THEN 'cache' ELSE 'new' END AS origin, array_to_string(list_transform(range(16), lambda i: CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 WHEN doc_id % 5 = 0 THEN doc_id % 11 ELSE len(list_filter(h, lambda x: x = '0123456789abcdef'[i + 1])) END), ',') AS vec FROM w""")
def embed_missing(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    one = lambda k: F.array_repeat((F.col("doc_id") % k).cast("double"), 16).alias("vec")
    plugin = n.select("path", one(7), (F.col("doc_id") % 3 == 0).alias("fresh"))
    cache = n.filter("doc_id % 5 = 0").select("path", "hash", one(11))
    done = plug.current_vectors(n.select("path", "hash", "text"), plugin, cache, plug.hash_embedder())
    return done.select("path", "origin", F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), ",").alias("vec"))


#: The stand-in model takes words of so many letters, and shorter ones that begin with a capital.
LONG_WORD = 8


def long_words(text: str) -> str:
    """A stand-in model over the whole text: all different capitalised or long words are entities, in the order of their
    first use; each use is related to the next different one. Texts with fewer than two have no answer. What it answers is
    as untidy as a model's: odd kinds, relations and blanks, nameless entities, relations without an end."""
    words = [w for w in re.findall("[A-Za-z]+", text) if len(w) >= LONG_WORD or w[0].isupper()]
    names, pairs = list(dict.fromkeys(words)), dict.fromkeys((a, b) for a, b in zip(words, words[1:]) if a != b)
    if len(names) < 2:
        return "nothing"
    entities = [{"name": f" {w}", "type": " Person " if w[0].isupper() else "Gadget", "aliases": ["", f"{w.lower()} "] if len(w) % 2 else None, "summary": f"about {w}\n"} for w in names]
    relations = [{"from": a, "rel": "Part_Of" if len(a) % 2 else "before", "to": f"{b} ", "to_type": "topic" if len(b) % 2 else "person"} for a, b in pairs]
    found = {"entities": [{"name": "  ", "type": "topic"}, *entities], "relations": [{"from": names[0], "rel": "about", "to": " "}, *relations]}
    return f"Here: {{not json}}\n```\n{json.dumps(found)}\n```" if len(names) % 2 else f"Here {{it is}}: {json.dumps(found)} {{and no more}}"


EXTRACT_SQL = f"""WITH {NOTES_SQL}, w AS (SELECT path, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) >= 8 OR regexp_matches(x, '^[A-Z]')) AS w FROM notes),
 i AS (SELECT path, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b, generate_subscripts(w, 1) AS i FROM w),
 n AS (SELECT path, a, min(i) AS i FROM i GROUP BY path, a),
 e AS (SELECT path, string_agg(a || '/' || CASE WHEN regexp_matches(a, '^[A-Z]') THEN 'person' ELSE 'topic' END || '/' || CASE WHEN length(a) % 2 = 1 THEN lower(a) ELSE '' END || '/about ' || a, ',' ORDER BY i) AS entities, count(*) AS n FROM n GROUP BY path),
 r AS (SELECT path, string_agg(a || '/' || CASE WHEN length(a) % 2 = 1 THEN 'part_of' ELSE 'related_to' END || '/' || b || '/topic/' || CASE WHEN length(b) % 2 = 1 THEN 'topic' ELSE 'person' END || '/', ',' ORDER BY i) AS relations FROM (SELECT path, a, b, min(i) AS i FROM i WHERE a <> b GROUP BY path, a, b) GROUP BY path)
 SELECT w.path, CASE WHEN e.n >= 2 THEN e.entities ELSE '' END AS entities, CASE WHEN e.n >= 2 THEN coalesce(r.relations, '') ELSE '' END AS relations, coalesce(e.n, 0) < 2 AS failed FROM w LEFT JOIN e USING (path) LEFT JOIN r USING (path)"""


@query("extract_entities", EXTRACT_SQL)
def extract_entities(spark, sf_dir):
    done = plug.extract(notes(spark, sf_dir), long_words)
    entities = F.transform("entities", lambda e: F.concat_ws("/", e["name"], e["type"], F.array_join(e["aliases"], "+"), e["summary"]))
    relations = F.transform("relations", lambda r: F.concat_ws("/", r["from"], r["rel"], r["to"], r["from_type"], r["to_type"], r["evidence"]))
    none = F.array().cast("array<string>")
    return done.select("path", F.array_join(F.coalesce(entities, none), ",").alias("entities"), F.array_join(F.coalesce(relations, none), ",").alias("relations"), F.col("error").isNotNull().alias("failed"))
