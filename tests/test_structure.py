"""Graph, blocking, filing and sheet operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from noteweave.operators import blocking, graph, index, organize, sheets


def test_redirects(spark):
    rows = [("a", "b", False), ("b", "c", False), ("c", None, False), ("x", "y", False), ("y", "x", False), ("m", "gone", False), ("r", None, True)] + [(f"k{i}", f"k{i + 1}" if i < 8 else None, False) for i in range(9)]
    got = {r.path: r.target for r in graph.resolve_redirects(spark.createDataFrame(rows, "path string, next string, gone boolean")).collect()}
    assert got["a"] == got["b"] == got["c"] == "c" and got["x"] is None and got["m"] is None and got["r"] is None and got["k3"] == "k8" and got["k2"] is None


def test_related_notes(spark):
    m = spark.createDataFrame([("A", "n1"), ("B", "n2"), ("C", "n3"), ("A", "n4")], "entity string, note string")
    e = spark.createDataFrame([("A", "r", "B"), ("C", "s", "B")], "src string, rel string, dst string")
    got = {r.note: (r.depth, r.via) for r in graph.related_notes(m, e, "n1", hops=3).collect()}
    assert got == {"n4": (0, "A"), "n2": (1, "A (r) B"), "n3": (2, "A (r) B (s) C")}
    assert {r.note for r in graph.related_notes(m, e, "n1", hops=1).collect()} == {"n4"}


def test_components(spark):
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert set(got.values()) == {"000", "x"} and len(got) == 43


@pytest.mark.parametrize(("n", "want"), [(11, [6, 5]), (21, [7, 7, 7]), (37, [10, 9, 9, 9]), (10, [10]), (1, [1])])
def test_balanced_chunks(spark, n, want):
    rows = spark.range(n).select(F.lit("g").alias("g"), F.lpad(F.col("id").cast("string"), 3, "0").alias("path"))
    got = blocking.balanced_chunks(rows, "g").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == want


@pytest.mark.parametrize(("sizes", "want"), [([3, 4, 3], [0, 0, 1]), ([6, 6], [0, 1]), ([9], [0])])
def test_pack_batches(spark, sizes, want):
    rows = spark.createDataFrame(list(enumerate(sizes)), "seq long, size long")
    assert [r.batch for r in blocking.pack_batches(rows, 8).orderBy("seq").collect()] == want


def test_journal(spark):
    j = spark.createDataFrame([(1, "t", False), (2, "t", True), (3, "u", False)], "seq long, to string, undone boolean")
    assert {(r.seq, r.to) for r in organize.latest_move(j).collect()} == {(1, "t"), (3, "u")}


def test_pending(spark):
    current = spark.createDataFrame([("new", "1"), ("same", "2"), ("changed", "3"), ("failed", "4"), ("benched", "5")], "path string, hash string")
    manifest = spark.createDataFrame([("same", "2"), ("changed", "x"), ("failed", "4")], "path string, hash string")
    failures = spark.createDataFrame([("failed", 1), ("benched", 3)], "path string, attempts int")
    assert {r.path for r in index.pending(current, manifest, failures).collect()} == {"new", "changed", "failed"}
    assert index.pending(current, manifest, failures, force=True).count() == 5


SHEET = sheets.Sheet({"co": sheets.Field("string", True), "n": sheets.Field("number"), "d": sheets.Field("date"), "s": sheets.Field("enum", values=("a", "b")), "url": sheets.Field("url")}, key=("co",), identity=("url", "n"))


def test_sheet_rules(spark):
    rows = spark.createDataFrame([("1", "X", 1.0, "2024-01-02", "a", None), ("2", "", None, None, "z", "ftp"), ("3", "y", 3.0, "bad", "", "http://q")], "path string, co string, n double, d string, s string, url string")
    paths = lambda f, **k: [r.path for r in sheets.query(rows, SHEET, f, **k).collect()]
    assert paths({"n": {"ne": 1}}) == ["2", "3"] and paths({"n": {"gt": 0}}) == ["1", "3"] and paths({"co": {"contains": "x"}}) == ["1"] and paths({"co": {"missing": True}}) == ["2"]
    assert paths({}, sort="n", descending=True) == ["3", "1", "2"] and paths({}, sort="n") == ["1", "3", "2"]
    for bad in ({"s": {"lt": "a"}}, {"n": {"like": 1}}, {"n": {"in": "abc"}}, {"other": {"gt": 1}}):
        with pytest.raises(ValueError, match="n|s|other"):
            sheets.query(rows, SHEET, bad)
    assert {r.path: r.error for r in sheets.check(rows, SHEET).collect()} == {"2": "s: not a enum", "3": "d: not a date"}


def test_upsert(spark):
    fields = "co string, n double, url string, body string"
    base = spark.createDataFrame([("p1", "Acme", None, "u1", "old"), ("p2", "Beta", None, None, "x"), ("p3", "Dup", None, None, "x"), ("p4", "Dup", None, None, "y")], f"path string, {fields}")
    new = spark.createDataFrame([(1, "ACME ", None, "u1", "new"), (2, "beta", None, "u9", "x"), (3, "acme", None, "u2", "z"), (4, "dup", None, None, "q"), (5, "none", None, None, "q"), (6, "beta", None, None, "x")], f"seq long, {fields}")
    got = {r.seq: (r.path, r.action) for r in sheets.upsert(base, new, SHEET).collect()}
    assert got[1] == ("p1", "update") and got[2] == ("p2", "update") and got[3] == (None, "insert") and got[4] == (None, "ambiguous") and got[5] == (None, "insert") and got[6][0] == "p2"
