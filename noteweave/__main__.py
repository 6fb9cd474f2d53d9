"""Command lines over a vault: ``python -m noteweave COMMAND --vault FOLDER``. Exit codes: 0 done, 1 faults found, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noteweave.operators import evals, index, rank, recall, sheets
from noteweave.sources import graph_notes, vault


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="noteweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("search", "sheets", "recall", "index", "organize", "graph", "evals"):
        commands.add_parser(name).add_argument("--vault", required=True)
    commands.choices["search"].add_argument("query")
    commands.choices["search"].add_argument("--limit", type=int, default=20)
    commands.choices["recall"].add_argument("--project", required=True)
    commands.choices["recall"].add_argument("--budget", type=int, default=recall.BUDGET)
    commands.choices["index"].add_argument("--manifest", help="table (path, hash) of what is indexed")
    commands.choices["evals"].add_argument("--golden", required=True)
    commands.choices["evals"].add_argument("--lenient", action="store_true")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    notes = vault.read_notes(spark, args.vault)
    say = lambda found: print(json.dumps(found, ensure_ascii=False, default=str))
    if args.command == "search":
        none = spark.createDataFrame([], "path string, vec array<double>")
        hits = rank.hybrid(notes, none, args.query, none.select(F.col("vec").alias("qvec")), args.limit)
        for r in hits.orderBy("rank").collect():  # ``limit`` rows
            say(r.asDict())
        return 0
    if args.command == "sheets":
        faults = 0
        for r in sheets.counts(notes).orderBy("folder").collect():  # a row for each sheet
            invalid, twice = [], []
            if r.error is None:
                sheet = sheets.get_sheet(notes, r.name)
                rows = sheets.sheet_rows(notes, sheet)
                invalid = [x.asDict() for x in sheets.check_notes(notes, sheet).orderBy("path").limit(100).collect()]
                twice = [x.asDict() for x in sheets.duplicates(rows, list(sheet.key), sheet).orderBy("path").limit(100).collect()]
            faults += bool(invalid or twice or r.error)
            say({**r.asDict(), "invalid": invalid, "duplicates": twice})
        return int(faults > 0)
    if args.command == "recall":
        print(recall.context_block(notes, args.project, args.budget))
        return 0
    if args.command == "index":
        current = vault.read_hashes(spark, args.vault)
        manifest = spark.read.parquet(args.manifest) if args.manifest else current.limit(0)
        say({r.state: r.n for r in index.drift(manifest, current).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()})
        return 0
    if args.command == "organize":
        say({"folders": sorted(r.folder for r in graph_notes.taxonomy(notes).collect()), "candidates": graph_notes.filing_candidates(notes).count()})
        return 0
    if args.command == "graph":
        entities, mentions, edges = graph_notes.rebuild(notes)
        say({"entities": entities.count(), "mentions": mentions.count(), "relations": edges.count()})
        return 0
    with open(args.golden, encoding="utf-8") as f:
        golden = evals.golden(spark, f.read(), args.golden.endswith(".md"))
    items = evals.judged_items(golden, notes)
    if not args.lenient:
        evals.require_present(items)
    lanes = [rank.bm25l(notes, q.query, 20).select(F.lit(q.id).alias("query"), F.col("path").alias("item"), "rank") for q in golden.collect()]
    hits = lanes[0]
    for lane in lanes[1:]:
        hits = hits.unionByName(lane)
    say(evals.summary(evals.per_query(items, hits, 5)).first().asDict())
    return 0


def main(words: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(words)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, args)
    except (ValueError, KeyError) as e:
        print(f"noteweave: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
