"""Toxicity: folding, matching against brute force, learning and held-out accuracy."""

import random
import time
import zlib

import pytest

from noteweave.llm import toxicity as tox


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", " "), ("123 -- 4.5", " "), ("You IDIOT!", " you idiot "), ("1d10t 1d1ot", " idiot idiot "), ("іdіоt", " idiot "), ("в 1998 год", " в год "), ("ｓｃｕｍ", " scum "), ("scu​m", " scum "), ("tr@$h, m0r0n.", " trash moron "),
        ("Straße ÉLAN", " straße élan "),
    ],
)
def test_fold(text, want):
    assert tox.fold(text) == want


def brute(model, folded):
    out, at = [], 0
    words = folded.split()
    innocent = [(i, i + len(p)) for p in model.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    for word in words:
        found = [(w, t) for t, w in model.terms.items() if f" {word} ".startswith(t)]
        if found:
            w, t = max(found)
            if not any(a <= at and at + len(t.rstrip()) <= b for a, b in innocent):
                out.append((at, t, w))
        at += len(word) + 1
    return out


def test_matches_are_those_of_brute_force():
    rng = random.Random(1)
    model = tox.Model({" ab": 1.0, " abc ": 2.0, " c ": 3.0, " bca": 1.5}, frozenset([" abc c ", " c ab "]))
    matcher = model.matcher()
    for _ in range(500):
        folded = tox.fold(" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(12))))
        assert tox.matches(matcher, folded) == brute(model, folded), folded


def corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        bad = i % 5 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["zwork", "qw1x", "zwork", "vyxk" + rng.choice(words)]))
        elif i % 7 == 0:
            text[1:1] = ["kind", "zwork"]  # an innocent phrase
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(bad)))
    return docs + [(9000, None, "x"), (9001, "", "x"), (None, "zwork", "x")], labels + [(None, 1, 1), (9000, 1, None)]


def test_learning_and_held_out_accuracy(spark, monkeypatch):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, weight string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(tox, "LEAST_SHARE", 0.3)
    model = tox.learn(d, lab)
    assert {t.split()[0][:3] for t in model.terms} == {"zwo", "qwi", "vyx"} or {t.strip() for t in model.terms} >= {"zwor"}
    assert " kind zwork " in model.exceptions
    rows = {r.doc_id: r for r in tox.score(d, model).collect()}
    assert len(rows) == len(docs) and rows[9000].score == rows[9001].score < 0.5 and not rows[9000].hits and rows[None].score > 0.7
    out = [(rows[i].score >= tox.THRESHOLD, bad) for i, _, bad in labels if i is not None and bad is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 300 and sum(a == bool(b) for a, b in out) / len(out) > 0.97
    assert tox.score(d, model).columns == ["doc_id", "text", "score", "n_words", "weight", "hits"]
    assert tox.score(d.limit(0), model).count() == 0
    again = tox.learn(d, lab)
    assert again.terms == model.terms


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = tox.learn(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in tox.score(d, model).collect()] == [0.0]


def test_long_texts_take_linear_time():
    began = time.process_time()
    assert tox.fold("a1 " + "9" * 1_000_000) == " ai "
    assert tox.fold("9" * 1_000_000 + "1d10t") == " idiot "
    assert tox.fold("1d10t" + "!" * 1_000_000) == " idiot "
    model = tox.Model({" ab": 1.0}, frozenset([" ab ab "]))
    found = tox.matches(model.matcher(), " ab c" * 50_000 + " ab" * 50_000 + " ")
    assert len(found) == 50_000
    assert time.process_time() - began < 20


def test_rows_that_share_an_id_are_learned_once(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, weight string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert tox.learn(d.unionAll(d), lab).terms == tox.learn(d, lab).terms
