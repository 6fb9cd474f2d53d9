"""A whole sweep over a small vault, and the command lines."""

import json

from noteweave import __main__ as cli
from noteweave.operators import librarian, plug


def test_sweep(spark):
    def model(text):
        if "broken" in text:
            raise RuntimeError("no answer")
        names = [w for w in text.split() if w[0].isupper()]
        return json.dumps({"entities": [{"name": n, "type": "topic"} for n in names], "relations": [{"from": a, "rel": "about", "to": b} for a, b in zip(names, names[1:])]})

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    notes = table([("Work/a.md", "Alpha and Beta"), ("Work/b.md", "see [[c]] AL-PHA"), ("c.md", "broken"), ("Home/d.md", "Gamma")], "path string, text string")
    entity = "path string, name string, type string, aliases array<string>, summary string"
    t = librarian.Tables(
        notes, table([("Work/a.md", "old"), ("gone.md", "x")], "path string, hash string"), table([("lost.md", "e", 1)], "path string, error string, attempts int"),
        table([("e/Alpha", "Alpha", "topic", [], ""), ("e/Stub", "Stub", "topic", [], "")], entity), table([("Alpha", "gone.md"), ("Stub", "Work/a.md")], "entity string, note string"),
        table([("Alpha", "about", "Stub")], "src string, rel string, dst string"), table([("Alpha", None, False), ("Stub", "Alpha", False)], "path string, next string, gone boolean"),
        table([("Work/a.md", [1.0, 0.0]), ("Work/b.md", [1.0, 0.1]), ("c.md", [1.0, 0.05]), ("Home/d.md", [0.0, 1.0])], "path string, vec array<double>"), table([], "path string, hash string, vec array<double>"), table([], "path string, hash string"),
    )
    embed = lambda texts: [[1.0, 0.01 * len(x)] for x in texts]
    candidates = table([("c.md", None), ("Work/a.md", "Work")], "path string, current string")
    after, steps, report, cursor = librarian.run_sweep(spark, t, model, embed, plug.same_letters, candidates)
    by = {s.name: s for s in steps}
    assert [s.error for s in steps] == [None] * 4, steps
    assert by["index"].numbers["processed"] == 3 and by["index"].numbers["failed"] == 1 and by["index"].numbers["mentions_retracted"] == 1
    assert by["organize"].numbers == {"move": 1, "propose": 0, "skip": 1}
    assert {r.path: r.text for r in after.notes.collect()}["Work/c.md"] == "broken" and "[[Work/c]]" in {r.path: r.text for r in after.notes.collect()}["Work/b.md"]
    assert {r.path: r.attempts for r in after.failures.collect()} == {"Work/c.md": 1}
    assert {r.path for r in after.manifest.collect()} == {"Work/a.md", "Work/b.md", "Home/d.md"}
    assert by["consolidate"].numbers["merges"] == 1 and cursor is None
    names = {r.name: r.aliases for r in after.entities.collect()}
    assert "AL-PHA" not in names or "Alpha" not in names
    found = {r.metric: (r.n, r.error) for r in report.collect()}
    assert len(found) == 8 and all(e is None for _, e in found.values()) and found["sweep_errors"][0] == 0 and found["stale_embeddings"][0] == 0


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "SparkSession", type("S", (), {"builder": type("B", (), {"config": lambda *_: type("C", (), {"getOrCreate": lambda *_: spark})()})()}))
    files = {"a.md": "red fish", "S/_schema.md": "---\nsheet: s\nfilename: '{k}'\nkey: [k]\ncolumns:\n  k: {type: string}\n---\n", "S/x.md": "---\nk: 1\n---\n", "S/y.md": "---\nk: one\nother: 2\n---\n", "Claude/Decisions.md": "- use red"}
    for path, text in files.items():
        (tmp_path / "v" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / path).write_text(text)
    v = f"{tmp_path}/v"
    lines = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert cli.main(["search", "--vault", v, "red"]) == 0 and {x["path"] for x in lines()} == {"a.md", "Claude/Decisions.md"}
    assert cli.main(["sheets", "--vault", v]) == 1
    (found,) = lines()
    assert found["rows"] == 2 and found["invalid"] == [{"path": "S/y.md", "error": "other: not declared"}] and found["duplicates"] == []
    assert cli.main(["recall", "--vault", v, "--project", "red"]) == 0 and capsys.readouterr().out == "- use red\n"
    assert cli.main(["index", "--vault", v]) == 0 and lines() == [{"added": 5}]
    assert cli.main(["organize", "--vault", v]) == 0 and lines() == [{"folders": [], "candidates": 1}]
    assert cli.main(["graph", "--vault", v]) == 0 and lines() == [{"entities": 0, "mentions": 0, "relations": 0}]
    (tmp_path / "g.yaml").write_text("- {id: q, query: fish, expect: a.md}\n- {id: r, query: fish, expect: gone.md}\n")
    assert cli.main(["evals", "--vault", v, "--golden", f"{tmp_path}/g.yaml"]) == 2
    assert cli.main(["evals", "--vault", v, "--golden", f"{tmp_path}/g.yaml", "--lenient"]) == 0 and lines()[-1]["mrr"] == 1.0
    assert cli.main(["nothing"]) == 2
