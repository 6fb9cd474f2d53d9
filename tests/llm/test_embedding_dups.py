"""Embedding near-duplicates and connected components against brute force."""

import random

import numpy as np

from noteweave.llm import embedding_dups as ed
from noteweave.llm.components import connected_components


def brute_components(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500 + k) for k in range(1, 90)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == brute_components(nodes, [p for p in pairs if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 17)) * rng.lognormal(size=(200, 1))
    x[50:100] = x[:50] + rng.normal(size=(50, 17)) * 0.3
    cos = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    i, j = ed.linked(x, x, 0.93)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(cos >= 0.93)), strict=True))


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        base = rng.normal(size=8) if i % 3 or not rows else np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=8) * 0.2
        rows.append((i, [float(v) for v in base], int(rng.integers(3))))
    rows += [(300 + k, rows[7][1], rows[7][2]) for k in range(40)]  # copies
    rows += [(400, [2 * v for v in rows[7][1]], rows[7][2]), (401, None, 1), (402, [0.0] * 8, 1), (403, [float("nan")] * 8, 1), (404, [1.0, None, 0.0], 1), (405, rows[7][1], None), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (408, [], 1)]
    rows += [(7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, class string").repartition(3)
    got = sorted((tuple(r) for r in ed.near_duplicates(df, block=16).collect()))

    def usable(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)

    pairs, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            (_, x, k), (_, y, m) = rows[a], rows[b]
            if k == m and usable(x, k) and usable(y, m) and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                pairs.append((a, b))
                n[a] += 1
                n[b] += 1
    comp = brute_components(range(len(rows)), pairs)
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, 10**9), rows[k][0])
    want = sorted((rows[k][0], n[k], least[comp[k]], rows[k][0] == least[comp[k]]) for k in range(len(rows)))
    assert got == want
    assert ed.near_duplicates(df.limit(0)).count() == 0
