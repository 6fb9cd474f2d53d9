"""Tool calls: linking, order, validation and canonical JSON."""

import json
import random

from noteweave.llm import tool_calls as tc

SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False)}, "g": {"x": ("number", True), "o": ("object", False), "l": ("array", False), "t": ("boolean", False)}}
CALL, RESULT = "conv long, turn long, id string, name string, arguments string, after array<string>", "conv long, turn long, id string, content string"


def run(spark, calls, results):
    return tc.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), SCHEMAS).collect()


def test_validation_and_json(spark):
    arguments = {
        "ok": ('f', '{"b": "é\\"\\n", "a": 1}', []), "type": ("f", '{"a": "1", "b": 2}', ["a:type", "b:type"]), "missing": ("f", "{}", ["a:missing"]), "unknown": ("f", '{"a": 1, "c": null}', ["c:unknown"]),
        "null": ("f", None, ["arguments"]), "bad": ("f", "{", ["arguments"]), "list": ("f", "[1]", ["arguments"]), "tool": ("h", "{}", ["name"]),
        "deep": ("g", '{"x": 1.5, "o": {"z": 1, "a": [true, null]}, "l": [], "t": false}', []), "float": ("f", '{"a": 1.5}', ["a:type"]),
    }
    rows = {r.id: r for r in run(spark, [(1, k, i, n, a, None) for k, (i, (n, a, _)) in enumerate(arguments.items())], [(1, 5, "ok", "r"), (1, 3, "ok", "first"), (2, 1, "type", "other"), (1, 9, "nobody", "x")])}
    for i, (_, _, errors) in arguments.items():
        assert list(rows[i].errors) == errors and rows[i].valid == (not errors), i
    assert rows["ok"].linked and not rows["type"].linked
    assert rows["ok"].json == '{"arguments":{"a":1,"b":"é\\"\\n"},"id":"ok","name":"f","result":"first"}'
    assert json.loads(rows["deep"].json)["arguments"] == {"x": 1.5, "o": {"z": 1, "a": [True, None]}, "l": [], "t": False} and '"o":{"a":[true,null],"z":1}' in rows["deep"].json


def test_order_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tc, "BLOCK", 3)
    rng = random.Random(1)
    calls = []
    for conv in (1, 2, None):
        for k in range(40):
            after = [str(rng.randrange(k)) for _ in range(rng.randrange(3))] if k else []
            calls.append((conv, k % 17, str(k), "f", '{"a":1}', after))
    calls += [(3, 0, "p", "f", "{}", ["q"]), (3, 1, "q", "f", "{}", ["p"]), (3, 2, "r", "f", "{}", ["p"]), (3, 3, "s", "f", "{}", ["gone"]), (3, 4, "s", "f", "{}", None), (3, 5, None, "f", "{}", None)]
    rows = run(spark, calls, [])
    assert len(rows) == len(calls)
    for conv in (1, 2):
        level = {}
        for _, _, i, _, _, after in (c for c in calls if c[0] == conv):
            level[i] = max((level[d] + 1 for d in after), default=0)
        got = {r.id: r for r in rows if r.conv == conv}
        assert {i: r.level for i, r in got.items()} == level
        order = sorted(got.values(), key=lambda r: (r.level, r.turn, r.id))
        assert [r.position for r in order] == list(range(40))
    third = {(r.id, r.turn): r for r in rows if r.conv == 3}
    assert all(third[k].level is None and third[k].position is None for k in (("p", 0), ("q", 1), ("r", 2), (None, 5)))
    assert third["s", 3].level == 0 and "after:gone" in third["s", 3].errors and "after:gone" not in third["s", 4].errors


def test_nothing(spark):
    assert run(spark, [], []) == []
    assert tc.transcript(tc.link(spark.createDataFrame([(1, 0, "i", "f", '{"a":1}', None)], CALL), spark.createDataFrame([(1, 1, "i", None)], RESULT), SCHEMAS)).first().json.endswith('"result":null}')


def test_nested_schemas(spark):
    v = tc.Value
    schema = {"f": {"o": v("object", True, properties={"it's": v("integer", True, minimum=0), "l": v("array", items=v("object", properties={"k": v("string", True, enum=("a", "b"))}), max_length=2)}), "n": v("number", maximum=10), "s": v("string", min_length=2), "any": v(), "big": v("integer")}}
    cases = {
        '{"o": {"it\'s": 1}}': [], '{"o": {"it\'s": 1.0, "l": [{"k": "a"}, {"k": "b"}]}, "n": 10, "s": "ok", "any": null, "big": 123456789012345678901234567890}': [],
        '{"o": {"it\'s": -1, "l": [{"k": "c"}, {}, {"k": 1, "z": 2}]}}': ["o.it's:range", "o.l:length", "o.l[0].k:enum", "o.l[1].k:missing", "o.l[2].k:type", "o.l[2].z:unknown"],
        '{"o": {"l": {}}, "n": 10.5, "s": "x", "big": 1.5}': ["big:type", "n:range", "o.it's:missing", "o.l:type", "s:length"], '{"o": null}': ["o:type"], '{"o": {"it\'s": true}}': ["o.it's:type"],
    }
    calls = spark.createDataFrame([(1, k, str(k), "f", a, None) for k, a in enumerate(cases)], CALL)
    got = {r.turn: list(r.errors) for r in tc.link(calls, spark.createDataFrame([], RESULT), schema).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_long_chains_of_diamonds_take_few_rounds(spark, monkeypatch):
    rounds = []
    jumped = tc._jumped
    monkeypatch.setattr(tc, "_jumped", lambda s: rounds.append(1) or jumped(s))
    calls = []
    for k in range(300):  # each joint waits for two calls, and both for the joint before
        before = [f"j{k - 1}"] if k else []
        calls += [(1, 4 * k, f"a{k}", "f", "{}", before), (1, 4 * k + 1, f"b{k}", "f", "{}", before), (1, 4 * k + 2, f"c{k}", "f", "{}", [f"b{k}"]), (1, 4 * k + 3, f"j{k}", "f", "{}", [f"a{k}", f"c{k}"])]
    got = {r.id: r.level for r in run(spark, calls, [])}
    assert all(got[f"j{k}"] == 3 * k + 2 and got[f"a{k}"] == 3 * k and got[f"c{k}"] == 3 * k + 1 for k in range(300)) and len(rounds) <= 4


def test_long_texts_and_other_columns(spark):
    text = "long " * 400_000
    calls = spark.createDataFrame([(1, 0, "i", "f", '{"a":1,"b":"' + text + '"}', None, "x", "y")], CALL + ", level string, content string")
    results = spark.createDataFrame([(1, 1, "i", text, "z")], RESULT + ", name string")
    (row,) = tc.link(calls, results, SCHEMAS).collect()
    assert row.valid and row.linked and row.level == 0 and json.loads(row.json) == {"arguments": {"a": 1, "b": text}, "id": "i", "name": "f", "result": text}


def test_links_are_hash_joins(spark):
    done = tc.link(spark.createDataFrame([(1, 0, "i", "f", '{"a":1}', None)], CALL), spark.createDataFrame([(1, 1, "i", "r")], RESULT), SCHEMAS)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan
