"""Fingerprints: chunking, likeness and neighbours against brute force."""

import hashlib
import random

import numpy as np
import pytest

from noteweave.llm import fingerprints as fp


def test_gear_is_the_rolling_hash():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    h, want = 0, []
    for b in data:
        h = (2 * h + int(fp.GEAR[b])) % 2**32
        want.append(h)
    assert fp.gear(data).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 40, 127, 128, 129, 5000])
def test_cut_points(n, monkeypatch):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    ends = fp.cut_points(data)
    assert (ends[-1] if ends else 0) == n and ends == sorted(set(ends))
    lengths = np.diff([0, *ends]).tolist()
    assert all(fp.LEAST <= k <= fp.MOST for k in lengths[:-1]) and all(k <= fp.MOST for k in lengths)
    monkeypatch.setattr(fp, "BLOCK", 64)
    assert fp.cut_points(data) == ends


def test_an_insertion_changes_few_chunks():
    words = " ".join(f"word{i * 7919 % 1000}" for i in range(800))
    a, b = fp.chunk_set(words), fp.chunk_set(words[:2000] + " inserted " + words[2000:])
    assert fp.likeness(a, b) > 0.9 and fp.likeness(a, a) == 1.0 and fp.likeness(a, fp.chunk_set("other " * 50 + "text")) == 0.0
    assert fp.decode_set(fp.encode_set(a)) == a


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    ordered = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    out = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = map(fp.chunk_set, (t, e, following))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.encode_set(a), fp.encode_set(b), fp.likeness(a, b), fp.likeness(a, c)))
    return out


def test_edits_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 3, None if i % 40 == 0 else " ".join(rng.choice(["été", "the", "gamma", "ray", "x", "🙂"]) for _ in range(rng.randrange(0, 120)))) for i in range(300)]
    rows += [(None, "no id " * 30), (5000, "y" * 30000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, range string").repartition(5)
    got = [tuple(r) for r in fp.compare_edits(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("rows", [[], [(1, "alone " * 20)], [(1, None), (1, None)], [(1, "a"), (1, "b"), (2, "")]])
def test_small_tables(spark, rows):
    got = fp.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if len(rows) == 1:
        assert got[0].near_next == 1.0


def test_many_rows_of_one_id(spark, tmp_path):
    rows = [(7, f"text {k % 50} of one id " * (1 + k % 3)) for k in range(2000)] + [(None, "no id")] * 500 + [(k, "w" * k) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/docs")
    sent = fp.with_next(spark.read.parquet(f"{tmp_path}/docs"))
    sizes = {r.range: r["count"] for r in sent.filter("ghost = 0").groupBy("range").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < len(rows) / 2
    got = fp.compare_edits(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 500
    texts = {t: fp.encode_set(fp.chunk_set(t)) for _, t in rows}
    assert {r.fingerprint for r in got if r.doc_id == 7} == {texts[t] for i, t in rows if i == 7}


def test_fingerprint_of_each_row(spark):
    rows = [(1, "one text " * 9), (2, None), (None, ""), (1, "a" * 100_000)]
    got = fp.fingerprint(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len(t or ""), fp.encode_set(fp.chunk_set(t or ""))) for i, t in rows), key=str)
