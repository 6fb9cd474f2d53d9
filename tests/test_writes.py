"""Capture, sessions, concepts, tasks, moves, entities and state in a folder."""

import datetime

import pytest

from noteweave.operators import organize
from noteweave.sources import graph_notes as gn
from noteweave.sources import sinks, vault

WHEN = datetime.datetime(2024, 5, 6, 7, 8)


def test_capture_writes(spark, tmp_path):
    root = f"file://{tmp_path}"
    read = lambda p: (tmp_path / p).read_text()
    assert sinks.log_session(spark, root, "A: title", "body", "proj", ["t"], WHEN) == "Claude/Sessions/2024-05-06 A title.md"
    assert sinks.log_session(spark, root, "a TITLE", "x", "proj", [], WHEN).endswith("2024-05-06 a TITLE 2.md")
    assert read("Claude/Sessions/2024-05-06 A title.md") == '---\ncreated: "2024-05-06 07:08"\nagent: claude\nproject: proj\ntags:\n- t\n---\n\nbody\n' or "created: 2024-05-06 07:08" in read("Claude/Sessions/2024-05-06 A title.md")
    assert read("Claude/Index.md") == "- [[2024-05-06 A title]] — proj: A: title\n- [[2024-05-06 a TITLE 2]] — proj: a TITLE\n"
    for text in ("one", "two"):
        sinks.capture(spark, root, text, WHEN)
    assert read("Claude/Inbox/2024-05-06.md") == "- 07:08 one\n- 07:08 two\n"
    assert sinks.upsert_concept(spark, root, "Big Idea", "first", WHEN) == sinks.upsert_concept(spark, root, "big idea", "second", WHEN) == "Claude/Concepts/Big Idea.md"
    assert read("Claude/Concepts/Big Idea.md").endswith("# Big Idea\n\nfirst\n\n## Update 2024-05-06\n\nsecond\n")
    sinks.add_task(spark, root, " do \n it ", "2024-06-01")
    sinks.add_task(spark, root, "more")
    assert read("Claude/Tasks.md").endswith("## Open\n\n- [ ] do it 📅 2024-06-01\n- [ ] more\n")
    with pytest.raises(ValueError, match="does not match"):
        sinks.add_task(spark, root, "x", "tomorrow")
    assert not [p for p in tmp_path.rglob("*.part")]


def test_state(spark, tmp_path):
    at = tmp_path / "state.json"
    assert vault.read_state(spark, f"file://{at}", {"sweeps": []}) == {"sweeps": []}
    at.write_text('{"cursor": "x"}')
    assert vault.read_state(spark, f"file://{at}", {"sweeps": []}) == {"sweeps": [], "cursor": "x"}
    at.write_text("{broken")
    assert vault.read_state(spark, f"file://{at}", {}) == {"status": "state file unreadable"}


def test_moves_and_undo(spark):
    notes = spark.createDataFrame([("a/x.md", "[[a/x]] [[a/xy]] [[b/y|t]]"), ("b/y.md", "[[a/x#h]][[a/x|q]] [[c/z"), ("c.md", "plain")], "path string, text string")
    moves = spark.createDataFrame([("a/x.md", "b/y2.md"), ("b/y.md", "a/x.md")], "source string, to string")  # one takes the other's place
    moved, counts = organize.apply_moves(notes, moves)
    assert {r.path: r.text for r in moved.collect()} == {"b/y2.md": "[[b/y2]] [[a/xy]] [[a/x|t]]", "a/x.md": "[[b/y2#h]][[b/y2|q]] [[c/z", "c.md": "plain"}
    assert {(r.path, r.source): r["count"] for r in counts.collect()} == {("a/x.md", "a/x.md"): 1, ("a/x.md", "b/y.md"): 1, ("b/y.md", "a/x.md"): 2}
    journal = spark.createDataFrame([(1, "old", "t", False), (2, "new", "t", False), (3, "q", "u", False)], "seq long, source string, to string, undone boolean")
    marked, back = organize.undo(journal, spark.createDataFrame([("t",)], "to string"))
    assert {r.seq: r.undone for r in marked.collect()} == {1: False, 2: True, 3: False} and [tuple(r) for r in back.select("source", "to").collect()] == [("t", "new")]


def test_entities_are_upserted(spark):
    schema = "path string, name string, type string, aliases array<string>, summary string"
    known = spark.createDataFrame([("P/39", "blue", "topic", ["part 39"], "", None, False), ("P/42", "x", "topic", ["part 42"], "old", None, True), ("S", "st", "topic", [], "", "P/39", False)], schema + ", next string, gone boolean")
    found = spark.createDataFrame([("PART 39", "topic", ["new 39"], "s"), ("x", "topic", ["z"], ""), ("ST", "topic", ["y"], "q"), ("Fresh: one", "person", ["f"], "s"), ("blue", "person", [], "")], schema.removeprefix("path string, "))
    got = {r.path: (list(r.aliases), r.summary, r.action) for r in gn.upsert_entities(known, found).collect()}
    assert got == {"P/39": (["part 39", "new 39", "ST", "y"], "", "extended"), "P/42": (["part 42", "z"], "old", "revived"), "S": ([], "", "kept"), "Claude/Graph/People/Fresh one": (["f"], "s", "created"), "Claude/Graph/People/blue": ([], "", "created")}


def test_sheets_are_no_taxonomy(spark):
    notes = spark.createDataFrame([("Work/a.md", ""), ("Work/sub/_schema.md", ""), ("Work/sub/row.md", ""), ("Table/_schema.md", ""), ("Table/r.md", ""), ("z.md", ""), ("a.md", "---\norganize: no\n---\n"), ("AGENTS.md", "")], "path string, text string")
    assert {r.folder for r in gn.taxonomy(notes, spark.createDataFrame([("Empty",), (".git",)], "path string")).collect()} == {"Work", "Empty"}
    assert [r.path for r in gn.filing_candidates(notes).collect()] == ["z.md", "Work/a.md"]
    assert gn.tombstone(gn.entity_note("A", "topic", ["b"], "sum"), "2024-01-02").startswith("---\nentity: topic\naliases:\n- b\nretired: 2024-01-02\n---\n")
