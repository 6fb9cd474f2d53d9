"""Sheets in folders, recall, evaluation sets and the manifest's life."""

import datetime

import pytest

from noteweave.operators import blocking, evals, index, recall, sheets

SCHEMA = "---\nsheet: {name}\nfilename: '{{co}} {{n}}'\nkey: [co]\nidentity: [url]\ncolumns:\n  co: {{type: string, required: true, max_length: 8}}\n  n: {{type: number}}\n  url: {{type: url}}\n  status: {{type: enum, values: [open, done]}}\n---\n\nRules.\n"


def test_discovery(spark):
    rows = [("S/_schema.md", SCHEMA.format(name="s")), ("S/a.md", "---\nco: A\nn: 1\n---\n"), ("S/sub/b.md", "---\nco: B\n---\n"), ("Claude/_schema.md", SCHEMA.format(name="s")), ("Bad/_schema.md", "---\nsheet: x\n---\n"), ("E/_schema.md", "---\nsheet: e\nfilename: f\nkey: [k]\ncolumns:\n  k: {type: enum}\n---\n")]
    notes = spark.createDataFrame(rows, "path string, text string")
    assert {r.name: (r.rows, r.error) for r in sheets.counts(notes).collect()} == {"s": (1, None), "x": (None, "missing 'filename'"), "e": (None, "enum column 'k' needs values")}
    sheet = sheets.get_sheet(notes, "s")
    assert (sheet.key, sheet.identity, sheet.filename, sheet.fields["co"].max_length, sheet.fields["status"].values) == (("co",), ("url",), "{co} {n}", 8, ("open", "done"))
    assert [(r.path, r.co, r.n) for r in sheets.sheet_rows(notes, sheet).collect()] == [("S/a.md", "A", "1")]
    with pytest.raises(KeyError, match="unknown sheet"):
        sheets.get_sheet(notes, "x")
    with pytest.raises(ValueError, match="duplicate sheet name 's': S, T"):
        sheets.discover(notes.union(spark.createDataFrame([("T/_schema.md", SCHEMA.format(name="s"))], notes.schema)))


SHEET = sheets.Sheet({"co": sheets.Field("string", True, max_length=8), "n": sheets.Field("number"), "url": sheets.Field("url"), "status": sheets.Field("enum", values=("open", "done")), "d": sheets.Field("date"), "ok": sheets.Field("bool")}, ("co",), ("url",), "s", "S", "{co} {n}")


def test_validation(spark):
    rows = [("1", "A", "12", "http://a b", None, None, None), ("2", "A", "1e3", "https://h/p", "open", "2024-01-02", "true"), ("3", "A", "x", None, None, None, None), ("4", "A", None, "ftp://h", None, None, None), ("5", "A", None, None, "", None, None), ("6", "A", None, None, None, "2024", None), ("7", "A", None, None, None, None, "yes"), ("8", None, None, None, None, None, None), ("9", "too long name", None, None, None, None, None), ("a", "A", None, "http:///x", None, None, None)]
    df = spark.createDataFrame(rows, "path string, co string, n string, url string, status string, d string, ok string")
    want = {"1": "url: not a url", "3": "n: not a number", "4": "url: not a url", "5": "status: not a enum", "6": "d: not a date", "7": "ok: not a bool", "8": "co: missing", "9": "co: longer than 8", "a": "url: not a url"}
    assert {r.path: r.error for r in sheets.check(df, SHEET).collect()} == want
    odd = spark.createDataFrame([("1", "A", "t", None), ("2", "A", None, 5)], "path string, co string, tags string, other int")
    assert {r.path: r.error for r in sheets.check(odd, SHEET).collect()} == {"2": "other: not declared"}


def test_merged(spark):
    fields = "co string, n double, url string, status string"
    base = spark.createDataFrame([("S/a.md", "A", 1.0, "http://x/", "open", "2024", "b"), ("S/c 3.0.md", "C", 2.0, None, None, "2024", "b")], f"path string, {fields}, created string, agent string")
    new = spark.createDataFrame([(1, "a ", None, "HTTP://X", "done"), (2, "C", 3.0, None, None), (3, "c", 9.0, "http://new", None), (4, "C", 3.0, "http://other", None), (5, "too long to be", 1.0, None, None)], f"seq long, {fields}")
    done = sheets.upsert(base, new, SHEET)
    assert {r.seq: (r.path, r.action, r.changed) for r in done.collect()} == {1: ("S/a.md", "update", "co,n,url,status"), 2: ("S/c 3.0.md", "update", "n"), 3: ("S/c 3.0.md", "update", "co,n,url"), 4: ("S/c 3.0.md", "update", "n,url"), 5: (None, "insert", None)}
    got = {r.path: (r.co, r.n, r.url, r.status, r.created, r.agent) for r in sheets.merged(base, new, done, SHEET, "now", "me").collect()}
    assert got == {"S/a.md": ("a ", None, "HTTP://X", "done", "2024", "me"), "S/c 3.0.md": ("C", 3.0, "http://other", None, "2024", "me")}
    assert [(r.seq, r.error) for r in sheets.refused(new, done, SHEET).collect()] == [(5, "co: longer than 8")]
    fresh = spark.createDataFrame([(7, "Z", 4.0, None, "open"), (8, "z", 4.0, None, None)], f"seq long, {fields}")
    made = sheets.upsert(base, fresh, SHEET)
    assert sorted(r.path for r in sheets.merged(base, fresh, made, SHEET, "now", "me").collect()) == ["S/Z 4.0.md", "S/a.md", "S/c 3.0.md", "S/z 4.0 2.md"]
    assert [r.line for r in sheets.log_entries(base, new.union(fresh), done.union(made), "2024-01-02", "me").orderBy("seq").collect()] == ["- 2024-01-02 status: open → done (agent: me)", "- 2024-01-02 status: (new) → open (agent: me)"]


def test_recall(spark):
    at = datetime.datetime(2024, 1, 10, 9, 30)
    rows = [("Claude/Sessions/one.md", "---\nproject: Zed\ncreated: 2024-02-01 10:00\n---\n\nlong   text\nhere", at), ("Claude/Sessions/zed two.md", "no front", at), ("Claude/Sessions/x.md", "other", at), ("Claude/Decisions.md", "- Zed first\n* zed no\n- other\n- for ZED", at), ("t.md", "- [ ] ask zed\n- [x] done zed\n- [ ] else", at)]
    notes = spark.createDataFrame(rows, "path string, text string, mtime timestamp")
    assert [(r.path, r.created, r.excerpt) for r in recall.sessions(notes, "ZED").collect()] == [("Claude/Sessions/one.md", "2024-02-01 10:00", "long text here"), ("Claude/Sessions/zed two.md", "2024-01-10 09:30", "no front")]
    assert [r.line for r in recall.decisions(notes, "zed").collect()] == ["- Zed first", "- for ZED"]
    assert recall.context_block(notes, "zed") == "Session: one — long text here\nSession: zed two — no front\nOpen task: ask zed\n- Zed first\n- for ZED"
    assert recall.context_block(notes, "zed", 40) == "Session: one — long text here" and recall.context_block(notes, "zed", 5) == "Sessi" and recall.context_block(notes, None) == ""
    assert [r.task for r in recall.digest(notes, at)["done_recently"].collect()] == ["done zed"] and recall.digest(notes, at + datetime.timedelta(1))["recent_notes"].count() == 0
    assert set(recall.resume(notes, "zed")) == {"sessions", "decisions", "tasks"}


GOLDEN = "- id: one\n  query: where is x\n  expect: n/a.md\n  accept: [n/b.md]\n- {id: 2, query: q, expect: [n/c.md, ../d.md], folder: n}\n"


def test_golden_sets(spark):
    got = {r.id: r for r in evals.golden(spark, GOLDEN).collect()}
    assert got["one"].expect == ["n/a.md"] and got["2"].folder == "n" and got["2"].tags == []
    assert evals.golden(spark, f"# Set\n```yaml\n{GOLDEN}```\n", markdown=True).count() == 2
    for bad, why in ((GOLDEN + GOLDEN, "duplicate"), ("- id: x\n", "query"), ("- {id: x, query: ' '}", "query"), ("a: b", "list"), ("- {id: x, query: y}", "expected"), ("- {id: x, query: y, expect: {a: b}}", "neither")):
        with pytest.raises(ValueError, match=why):
            evals.golden(spark, bad)
    notes = spark.createDataFrame([("n/b.md",), ("n/c.md",), ("../d.md",)], "path string")
    items = evals.judged_items(evals.golden(spark, GOLDEN), notes)
    with pytest.raises(ValueError, match=r"2: \.\./d\.md; one: n/a\.md"):
        evals.require_present(items)
    hits = spark.createDataFrame([("2", "n/c.md", 2), ("one", "n/b.md", 1)], "query string, item string, rank int")
    scored = evals.per_query(items, hits, 5)
    assert [tuple(r) for r in scored.select("query", "recall", "first_rank").collect()] == [("2", 1.0, 2)]  # the other expects nothing that is there
    assert '"mrr": 0.5' in evals.record(scored, "now", "abc", "v", "g")


def test_manifest_life(spark):
    rows = [("a", '"old error"'), ("b", '{"error": "e", "attempts": 2}'), ("Claude/Librarian.md", '"x"')]
    failures = index.normal_failures(spark.createDataFrame(rows, "path string, value string"), ["Claude/Librarian.md"])
    assert sorted(tuple(r) for r in failures.collect()) == [("a", "old error", 1), ("b", "e", 2)]
    left = iter([3, 1, 0])
    assert index.drain(lambda: next(left)) == 3
    with pytest.raises(RuntimeError, match="2 rounds"):
        index.drain(lambda: 1, 2)
    assert [r.path for r in index.skipped(failures, failures, 2).collect()] == ["b"]


def test_backstop():
    now = datetime.datetime(2024, 1, 20, 12)
    assert not blocking.backstop_due(None, now) and blocking.backstop_due("2024-01-06 12:00:00", now) and not blocking.backstop_due("2024-01-06 12:00:01", now)


def test_slices(spark):
    rows = spark.createDataFrame([(f"{k:02}", k % 2 == 0) for k in range(10)], "path string, checked boolean")
    part = blocking.select_slice(rows, "04", 8)
    assert [r.path for r in part.collect()] == ["01", "03", "05", "07", "09", "06", "08", "00"] and blocking.next_cursor(rows, part, "04") == "00"
    part = blocking.select_slice(rows, "04", 8, backstop=False)
    assert part.count() == 5 and blocking.next_cursor(rows, part, "04") == "04"


@pytest.mark.parametrize("most", [1, 4, 7])
def test_batches_against_a_loop(spark, most, monkeypatch):
    monkeypatch.setattr(blocking, "BLOCK_ITEMS", 8)
    sizes = [1 + (k * 7919) % 5 for k in range(100)]
    want, batch, full = [], 0, 0
    for s in sizes:
        if full and full + s > most:
            batch, full = batch + 1, 0
        full += s
        want.append(batch)
    got = blocking.pack_batches(spark.createDataFrame(list(enumerate(sizes)), "seq long, size long"), most).orderBy("seq").collect()
    assert [r.batch for r in got] == want
