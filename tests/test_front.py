"""Front matter: reading, writing and patching."""

import pytest
from pyspark.sql import functions as F

from noteweave.functions import front
from noteweave.operators import notes as nt


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ("tags:\n- alpha\n- beta\nproject: \"X y\"\n", {"tags": ["alpha", "beta"], "project": "X y"}),
        ("a: [1, 'two', three four, {k: v}]\nb:\n  c: d\n  e:\n    - 1\n    - f: 2\n      g: 3\n", {"a": [1, "two", "three four", {"k": "v"}], "b": {"c": "d", "e": [1, {"f": 2, "g": 3}]}}),
        ("x: ~\ny: yes\nz: 0x1F\nw: 1.5\nv: 12:30\nu: 'it''s'\nt: \"a\\tb\\u00e9\"", {"x": None, "y": True, "z": 31, "w": 1.5, "v": 750, "u": "it's", "t": "a\tbé"}),
        ("s: |\n  line1\n   line2\n\n  line3\nf: >\n  a\n  b\n\n  c\n", {"s": "line1\n line2\n\nline3\n", "f": "a b\nc\n"}),
        ("# c\na: b # c\nc: d#e\n", {"a": "b", "c": "d#e"}), ("multi: one\n  two\nk: v", {"multi": "one two", "k": "v"}), ("a: [x,\n  y]\nb: 1", {"a": ["x", "y"], "b": 1}),
        ("u: http://x.y/z?a=b\nd: 2024-01-02\nq: 'a: b'", {"u": "http://x.y/z?a=b", "d": "2024-01-02", "q": "a: b"}), ("l: []\nm: {}\ne:", {"l": [], "m": {}, "e": None}),
        ("a: b: c", {}), ("- 1\n- 2", {}), ("a:\n  - b\n c: d", {}), ("\ttab: 1", {}), ("a: *x", {}), ("k: \"unterminated", {}), ("plain", {}), ("a: 'x' y", {}), ("", {}),
    ],
)
def test_blocks(block, want):
    assert front.parse(block) == want


def test_against_a_yaml_library():
    yaml = pytest.importorskip("yaml")
    for block in ("a: 007\nb: 08\nc: 1_000\nd: 1e5\ne: 1.0e+5\n", "list:\n  -\n    x: 1\n  - - 1\n    - 2\n", "a:\n\n  b: 1\n\n\nc: 2", "k: |-\n  x\n  y\nl: >+\n  z\n\n", "columns:\n  st: {type: enum, values: [a, b]}\nkey: [name]\n"):
        assert front.parse(block) == yaml.safe_load(block), block


def test_what_is_written_is_read_again():
    meta = {"a": "x", "b": "yes", "c": "1", "d": ["p", "q: r", ""], "e": None, "f": True, "g": 2.5, "h": "2024-01-02", "i": "- x", "j": "tail ", "k": 'say "hi"', "l": [], "m": "#no", "n": "a\nb"}
    text = front.write(meta)
    assert front.parse(text.split("---")[1]) == meta
    patched = front.patch(text + "body\n---\nrest", {"d": ["new"], "z": "added"})
    assert front.parse(patched[3 : patched.find("\n---", 3)]) == meta | {"d": ["new"], "z": "added"} and patched.endswith("\n---\n\nbody\n---\nrest")
    assert front.patch("no front", {"a": 1}).startswith("---\na: 1\n---")


def test_log_lines():
    assert front.add_to_section("x\n", "Log", "- a") == "x\n\n## Log\n- a\n"
    assert front.add_to_section("## Logistics\n\n## Log\n- a\n\n## End\nz", "Log", "- b") == "## Logistics\n\n## Log\n- a\n- b\n\n## End\nz"


def test_columns(spark):
    rows = [("a", "---\nproject: ~\ntags: one\norganize: false\n---\n"), ("b", "---\nproject: No\ntags: false\norganize: 'false'\n---\n"), ("c", "---\nbad: [\n---\n"), ("d", "none"), ("e", None), ("f", "---\n{}\n---\n")]
    notes = spark.createDataFrame(rows, "path string, text string").withColumn("m", front.meta(F.col("text")))
    got = {r.path: (r.p, r.t, r.o) for r in notes.select("path", front.value(F.col("m"), "project").alias("p"), front.values(F.col("m"), "tags").alias("t"), front.is_false(F.col("m"), "organize").alias("o")).collect()}
    assert got == {"a": (None, ["one"], True), "b": ("false", [], False), **{k: (None, [], False) for k in "cdef"}}
    assert [r.path for r in nt.query_notes(notes.drop("m"), project="none").collect()] == ["a"]
    assert sorted(r.path for r in nt.query_notes(notes.drop("m")).collect()) == ["a", "b"]
