"""Reading and ingesting folders of notes."""

from noteweave.sources import vault
from noteweave.streaming import ingest


def make(tmp_path):
    root = tmp_path / "my vault"
    for path, data in {"a/b.md": b"one", "a b.md": b"two \xff!", ".git/x.md": b"no", "a/.trash/y.md": b"no", "c.txt": b"no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    return root


def test_notes_and_hashes(spark, tmp_path):
    root = make(tmp_path)
    assert {r.path: r.text for r in vault.read_notes(spark, str(root)).collect()} == {"a/b.md": "one", "a b.md": "two !"}
    assert [r.path for r in vault.read_notes(spark, str(root), "a").collect()] == ["a/b.md"]
    assert {r.path for r in vault.read_hashes(spark, str(root)).collect()} == {"a/b.md", "a b.md"}
    for path, data in {"Claude/Graph/Topics/t.md": b"t", "Claude/Librarian.md": b"l", "copilot/c.md": b"c", "kept.md": "\ufffd ok".encode(), "both.md": "\ufffd".encode() + b"\xff!", "t.md": b"---\ntags:\n- x\n---\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    texts = {r.path: r.text for r in vault.read_notes(spark, str(root)).collect()}
    assert texts["kept.md"] == "\ufffd ok" and texts["both.md"] == "\ufffd!" and "copilot/c.md" in texts
    assert [r.path for r in vault.read_notes(spark, str(root), tags=["X"]).collect()] == ["t.md"]
    assert {r.path for r in vault.read_hashes(spark, str(root)).collect()} == {"a/b.md", "a b.md", "kept.md", "both.md", "t.md"}
    paths = vault.read_paths(spark, str(root))
    assert paths.count() == 8 and "content" not in paths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_journal_and_vectors(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in vault.read_journal(spark, str(tmp_path / "j.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "v").mkdir()
    line = '"src:n.md": {"path": "n.md", "embeddings": {"m": {"vec": [1, %d]}}, "last_embed": {"at": 5}},\n'
    (tmp_path / "v/1.ajson").write_text(line % 2 + line % 3 + '"other:x": {"path": "x"},\n')
    (tmp_path / "v/2.ajson").write_text('"src:z.md": {bad},\n' + (line % 9).replace("n.md", "z.md"))
    got = vault.read_vectors(spark, str(tmp_path / "v"), "src:", "m").collect()
    assert [(r.path, list(r.vec), r["at"]) for r in got] == [("n.md", [1.0, 3.0], 5)]


def test_names(spark):
    taken = spark.createDataFrame([("x/Log.md",), ("y/log 2.md",)], "path string")
    wanted = spark.createDataFrame([(1, "log"), (2, "New"), (3, "new")], "seq long, stem string")
    assert {r.seq: r.name for r in vault.free_names(wanted, taken).collect()} == {1: "log 3", 2: "New", 3: "new 2"}
    taken = spark.createDataFrame([("a - 3.md",), ("b.md",), ("b 3.md",), ("c 2.md",)], "path string")
    wanted = spark.createDataFrame([(1, "A - 3"), (2, "b"), (3, "b"), (4, "c"), (5, "c")], "seq long, stem string")
    assert {r.seq: r.name for r in vault.free_names(wanted, taken).collect()} == {1: "A - 3 2", 2: "b 2", 3: "b 4", 4: "c", 5: "c 3"}


def test_stream(spark, tmp_path):
    schema = "path string, text string, mtime timestamp"
    source, folder, mark = (f"{tmp_path}/{x}" for x in ("in", "manifest", "mark"))
    seen = []

    def run():
        notes = spark.readStream.schema(schema).parquet(source)
        ingest.ingest(notes, folder, mark, lambda rows, n: seen.append(sorted(r.path for r in rows.collect()))).awaitTermination()

    at = "2024-01-01 00:00:00"
    spark.createDataFrame([("a", "1", at), ("b", "1", at)], "path string, text string, mtime string").selectExpr("path", "text", "timestamp(mtime) mtime").write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("a", "1", at), ("b", "2", at), ("c", "3", at)], "path string, text string, mtime string").selectExpr("path", "text", "timestamp(mtime) mtime").write.mode("append").parquet(source)
    run()
    assert seen == [["a", "b"], ["b", "c"]]
    assert ingest.manifest(spark, folder).count() == 3


def test_graph_notes(spark):
    from noteweave.sources import graph_notes as gn

    text = gn.entity_note("Acme", "organization", ["AC", "Ac me"], "Makes things.").replace("## Mentions\n", "## Mentions\n- [[n/one|One]] — seen\n- [[n/two|Two]]\n").replace("## Relations\n", "## Relations\n- owns [[Claude/Graph/Topics/X|X]]\n")
    stub = "---\nentity: topic\nmerged_into: Claude/Graph/Topics/Y\n---\n# X\n"
    rows = [("Claude/Graph/Organizations/Acme.md", text), ("Claude/Graph/Topics/X.md", stub), ("Work/a.md", "x"), ("b.md", "y"), ("README.md", "z"), ("c.md", "---\norganize: false\n---\n")]
    notes = spark.createDataFrame(rows, "path string, text string")
    entities, mentions, edges = gn.rebuild(notes)
    (e,) = entities.collect()
    assert (e.path, e.name, e.type, e.summary, e.aliases) == ("Claude/Graph/Organizations/Acme", "Acme", "organization", "Makes things.", ["AC", "Ac me"])
    assert sorted((r.note, r.evidence) for r in mentions.collect()) == [("n/one", "seen"), ("n/two", "")]
    assert [(r.rel, r.dst) for r in edges.collect()] == [("owns", "Claude/Graph/Topics/X")]
    assert {(r.path.rsplit("/")[-1], r.next) for r in gn.redirects(notes).collect()} == {("Acme", None), ("X", "Claude/Graph/Topics/Y")}
    assert [r.folder for r in gn.taxonomy(notes).collect()] == ["Work"]
    assert {r.path for r in gn.filing_candidates(notes).collect()} == {"Work/a.md", "b.md"}


def test_sinks(spark, tmp_path):
    import pytest

    from noteweave.sources import sinks

    root = f"file://{tmp_path}"
    sinks.write_note(spark, root, "Claude/a.md", "one\r\n")
    sinks.append_note(spark, root, "Claude/a.md", "two\n")
    assert (tmp_path / "Claude/a.md").read_text() == "one\ntwo\n"
    with pytest.raises(FileExistsError):
        sinks.write_note(spark, root, "Claude/a.md", "x")
    with pytest.raises(PermissionError):
        sinks.write_note(spark, root, "b.md", "x")
    for bad in ("../x.md", "/etc/x", "C:/x"):
        with pytest.raises(ValueError, match="outside"):
            sinks.write_note(spark, root, bad, "x", confirm_outside=True)
    sinks.move_note(spark, root, "Claude/a.md", "Work/b.md")
    assert (tmp_path / "Work/b.md").exists() and not (tmp_path / "Claude/a.md").exists()


def test_extraction(spark):
    from noteweave.operators import plug, sweep

    notes = spark.createDataFrame([("n1", "Ada Acme"), ("n2", "bad")], "path string, text string")
    model = lambda t: '{"entities": [{"name": "ada", "type": "Person"}, {"name": " ", "type": "x"}], "relations": [{"from": "Ada", "rel": "Joins", "to": "New Co"}, {"from": "", "to": "x"}]}' if "Ada" in t else "none"
    done = plug.extract(notes, model)
    assert {r.path: bool(r.error) for r in done.collect()} == {"n1": False, "n2": True}
    new, mentions, edges = plug.apply_extraction(spark.createDataFrame([("Ada Lovelace", ["ADA"])], "name string, aliases array<string>"), done)
    assert [(r.name, r.type) for r in new.collect()] == [("New Co", "topic")]
    assert [(r.entity, r.note) for r in mentions.collect()] == [("Ada Lovelace", "n1")]
    assert [(r.src, r.rel, r.dst) for r in edges.collect()] == [("Ada Lovelace", "related_to", "New Co")]  # "Joins" is no known relation
    a, b, c = sweep.run({"a": dict, "b": lambda: 1 / 0, "c": lambda: {"faults": 2}})
    assert a.error is None and b.error.startswith("ZeroDivisionError") and [s.line[0] for s in (a, b, c)] == ["✓", "⚠", "⚠"]
    assert [r.step for r in sweep.errors(spark, [a, b, c]).collect()] == ["b"]
