"""Extraction over whole texts, against plain Python."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from noteweave.operators import plug
from noteweave.plans import maintenance, registry


def test_extract_entities_reads_whole_texts(spark, tmp_path):
    far = "a b " * 4000 + "Anna met remarkable Bert and Anna"
    texts = ["one two Three remarkable", far, "a b c", "", None, "Ada Ada elsewhere"]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": "s"} for i, t in enumerate(texts)]), tmp_path / "documents.parquet")
    rows = registry.QUERIES["extract_entities"](spark, str(tmp_path)).collect()
    got = {r["path"]: ([e.split("/")[0] for e in r["entities"].split(",") if e], len([x for x in r["relations"].split(",") if x]), r["failed"]) for r in rows}
    want = [(["Three", "remarkable"], 1, False), (["Anna", "remarkable", "Bert"], 3, False), ([], 0, True), ([], 0, True), ([], 0, True), (["Ada", "elsewhere"], 1, False)]
    assert got == {f"s/en/{i}.md": w for i, w in enumerate(want)}
    (first,) = [r for r in rows if r["path"] == "s/en/0.md"]
    assert first["entities"] == "Three/person/three/about Three,remarkable/topic//about remarkable" and first["relations"] == "Three/part_of/remarkable/topic/person/"


def test_answers(spark):
    assert [plug.answer_json(t) for t in ('x ```json\n{"a": 1}\n``` y', '```\n{"a": {"b": 2}}\n```', 'no {x} but {"c": 3} and {"d": 4}')] == ['{"a": 1}', '{"a": {"b": 2}}', '{"c": 3}']
    for bad in ("```json\n{broken}\n``` {\"a\": 1}", "none", "[1]"):
        with pytest.raises(ValueError):
            plug.answer_json(bad)
    answer = '{"entities": [{"name": " A ", "type": " PERSON", "aliases": [" x ", ""], "summary": " s "}, {"name": " "}, {"name": "B", "type": "odd"}], "relations": [{"from": "A", "rel": "weird", "to": "B", "from_type": "person", "evidence": " e"}, {"from": "A", "rel": "About", "to": ""}]}'
    e, r = plug.clean_extraction(F.lit(answer))
    row = spark.range(1).select(e.alias("e"), r.alias("r")).first()
    assert [tuple(x) for x in row.e] == [("A", "person", ["x"], "s"), ("B", "topic", [], "")]
    assert [tuple(x) for x in row.r] == [("A", "related_to", "B", "person", "topic", "e")]


def test_long_answers_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(plug, "HELD", 3)
    notes = spark.createDataFrame([(f"n{i}", f"Anna{i} Bert{i}") for i in range(20)], "path string, text string").coalesce(1)
    got = plug.extract(notes, maintenance.long_words).collect()
    assert sorted((r["path"], len(r["entities"]), len(r["relations"])) for r in got) == sorted((f"n{i}", 2, 1) for i in range(20))
