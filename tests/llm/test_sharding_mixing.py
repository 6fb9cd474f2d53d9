"""Sharding and source mixing against their definitions."""

import random
import re
from collections import defaultdict

import pytest

from noteweave.llm import mixing, sharding


def corpus(n=600):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot text " * 40, "été " * rng.randrange(60), None, "", f"doc {i} " * rng.randrange(1, 50)]), "x") for i in range(n)]
    return rows + [rows[5]] * 300 + [(None, "no id", "y"), (None, None, None)]


def check_shards(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        by[r["shard"]].append(r)
    assert len(rows) == texts and set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_shards_are_near_equal(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string").repartition(3)
    check_shards(sharding.assign(docs, 7).collect(), len(rows), 7)
    monkeypatch.setattr(sharding, "LEAST_RANGES", 16)
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)  # bad splitters, so ranges are split anew
    monkeypatch.setattr(sharding, "OVERFULL", 1.1)
    check_shards(sharding.assign(docs, 7).collect(), len(rows), 7)


def test_shards_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, shard string")
    assert sharding.assign(docs, 4).columns == ["doc_id", "text", "size", "shard", "slot"] and sharding.assign(docs, 4).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, extra string")
    sharding.write_shards(sharding.assign(docs, 5), f"file://{tmp_path}/out", 5, rows_per_file=100)
    assert spark.read.parquet(f"file://{tmp_path}/out").groupBy("shard").count().count() == 5


@pytest.mark.parametrize("text", ["", "a", " a  b\t\nc ", "\x1c \x85 x", "é b c", None])
def test_words(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(mixing.words_of(mixing.F.col("t")).alias("n")).first().n
    assert got == len(re.findall(mixing.WORD, text or ""))


def test_targets():
    got = mixing.targets({"a": 10, "b": 100, "c": 1000, None: 5}, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * 1115, 2)
    assert got["a"] == 20 and got[None] == 10 and got["b"] == 200 and abs(sum(got.values()) - 1672.5) < 1e-9
    assert mixing.targets({"a": 0, "b": 4}, {"a": 3, "b": 1}, 6, 2) == {"a": 0.0, "b": 6.0}
    assert mixing.targets({"a": 0}, {"a": 3}, 0, 2) == {"a": 0.0}


def test_inverse_of_the_integral(spark):
    knots = [(0.0, 1.0), (0.25, 3.0), (1.0, 0.5)]
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))

    def integral(t):
        done = 0.0
        for a, b in zip(knots, knots[1:], strict=False):
            if t > a[0]:
                to = min(t, b[0])
                done += (to - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (to - a[0]) / (b[0] - a[0])) / 2
        return done / whole

    for r in spark.range(101).select((mixing.F.col("id") / 100).alias("s")).withColumn("t", mixing._inverse(knots, mixing.F.col("s"))).collect():
        assert abs(integral(r.t) - r.s) < 1e-9


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else "w " * rng.randrange(0, 90), rng.choice(["s1", "s1", "s1", "s2", "s3", None, "Z"]), "x") for i in range(900)]
    rows += [rows[1]] * 200 + [(None, "null id here", "s2", "x"), (7000, None, "empty", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and "target" in got[0].__fields__
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(re.findall(mixing.WORD, r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets(sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(mixing.WORD, r.text or "")) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == len(r.positions) * r["size"] <= 2 * r["size"] and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 90 for s in sizes)
    again = {(r.doc_id, r.taken, tuple(r.positions)) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken, tuple(r.positions)) for r in got}
    places = [r.position for r in mixing.range_sorted(mixing.mix(docs)).collect()]
    assert places == sorted(places) and len(places) == sum(len(r.positions) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_positions_against_direct_integration(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 40), rng.choice(["a", "a", "b", None])) for i in range(300)], "doc_id long, text string, source string").repartition(3)
    hashes = {r.doc_id: r.h % 2**64 for r in docs.select("doc_id", mixing.F.xxhash64("doc_id", "text", mixing.F.lit("mix")).alias("h")).collect()}
    rows = mixing.mix(docs).collect()
    for number, source in enumerate(("a", "b", None)):
        part = sorted((r for r in rows if r.source == source), key=lambda r: hashes[r.doc_id])
        weight, tilt = (3.0, 1.0, 2.0)[number], 0.5 if number % 2 else -0.5
        low, high = weight * (1 - tilt), weight * (1 + tilt)
        integral = lambda t: low * t + (high - low) * t * t / 2  # noqa: E731, B023  of a straight line: the middle knot lies on it
        begin, whole = 0, sum(r["size"] for r in part)
        for r in part:
            starts = [v for v in (begin, begin + whole) if v + r["size"] / 2 < r.target]
            assert len(starts) == len(r.positions)
            for v, t in zip(starts, r.positions, strict=True):
                assert abs(integral(t) / integral(1) - v / r.target) < 1e-9
            begin += r["size"]


def test_a_schedule_of_its_own_and_many_sources(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 5) AS text", "concat('s', id % 1500) AS source")
    late = spark.createDataFrame([("s7", [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)])], "source string, knots array<struct<time:double,weight:double>>")
    rows = mixing.mix(docs, schedules=late, budget_share=1.0).collect()
    assert all(p >= 0.5 for r in rows if r.source == "s7" for p in r.positions) and any(r.positions for r in rows if r.source == "s7")
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += 1 + r.doc_id % 5
    want = mixing.targets(sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}, float(sum(sizes.values())), 2.0)
    assert all(r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 for r in rows)


def test_overfull_buckets_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    monkeypatch.setattr(mixing, "OVERFULL", 2)
    rows = [(7, "same words here", "a")] * 500 + [(i, "w " * (1 + i % 9), "b") for i in range(200)] + [(9, "long " * 200_000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == len(rows) and abs(sum(r.taken for r in got if r.source == "a") - next(r.target for r in got if r.source == "a")) <= 3
