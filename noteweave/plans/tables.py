"""The driver's tables as notes: path, text and what else the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: source/lang/id.md."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "text")


def marked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes with front matter, a heading, a task and a link."""
    n = F.col("doc_id")
    text = F.concat(
        F.lit("---\ntags: ["), F.col("lang"), F.lit(", T"), (n % 3).cast("string"), F.lit("]\nproject: "), F.col("source"), F.lit("\n---\n# Doc "), n.cast("string"),
        F.lit("\n- ["), F.when(n % 2 == 0, "x").otherwise(" "), F.lit("] review [[src/"), F.col("source"), F.lit("|s]]\n[["), (n % 50).cast("string"), F.lit("]]\n"), F.col("text"),
    )
    return notes(spark, sf_dir).withColumn("text", text)


#: The same in DuckDB, as common table expressions.
NOTES_SQL = "notes AS (SELECT doc_id, lang, source, source || '/' || lang || '/' || doc_id || '.md' AS path, text FROM documents)"
MARKED_SQL = (
    "notes AS (SELECT doc_id, lang, source, source || '/' || lang || '/' || doc_id || '.md' AS path, '---\ntags: [' || lang || ', T' || (doc_id % 3) || ']\nproject: ' || source || '\n---\n# Doc ' || doc_id || '\n- [' || "
    "CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE ' ' END || '] review [[src/' || source || '|s]]\n[[' || (doc_id % 50) || ']]\n' || text AS text FROM documents)"
)


def block_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes whose front matter has block lists, quoted texts, nested keys and comments."""
    n = F.col("doc_id")
    text = F.concat(
        F.lit("---\n# kept by hand\ntags:\n- "), F.col("lang"), F.lit("\n- 'T"), (n % 3).cast("string"), F.lit("' # quoted\nproject: \""), F.col("source"), F.lit(": x\"\nowner:\n  name: o"), (n % 7).cast("string"),
        F.lit("\n  active: "), F.when(n % 2 == 0, "yes").otherwise("no"), F.lit("\naliases: [a"), (n % 5).cast("string"), F.lit(", \"b, c\"]\nnote: >\n  folded\n  text "), n.cast("string"), F.lit("\n---\n"), F.coalesce("text", F.lit("")),
    )
    return notes(spark, sf_dir).withColumn("text", text)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("path"), F.col("label").cast("string").alias("folder"), F.col("embedding").alias("vec"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as entities: path, name, type and two aliases."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("P/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array("p_brand", F.concat(F.lit("part "), F.col("p_partkey").cast("string"))).alias("aliases"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as mentions of parts in orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("P/"), F.col("l_partkey").cast("string")).alias("entity"), F.concat(F.lit("O/"), F.col("l_orderkey").cast("string")).alias("note"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as relations from parts to suppliers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("P/"), F.col("l_partkey").cast("string")).alias("src"), F.lit("supplied_by").alias("rel"), F.concat(F.lit("S/"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()


GRAPH_SQL = (
    "entities AS (SELECT 'P/' || p_partkey AS path, p_name AS name, p_type AS type, [p_brand, 'part ' || p_partkey] AS aliases FROM part), "
    "mentions AS (SELECT 'P/' || l_partkey AS entity, 'O/' || l_orderkey AS note FROM lineitem), "
    "edges AS (SELECT DISTINCT 'P/' || l_partkey AS src, 'supplied_by' AS rel, 'S/' || l_suppkey AS dst FROM lineitem)"
)
