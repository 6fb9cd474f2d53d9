"""Health counts and filing over all rows, against plain Python on the smallest or synthetic tables."""

import math
import os
import shutil

import pyarrow.parquet as pq
import pytest

import noteweave.plans.retrieval
import noteweave.plans.structure  # noqa: F401
from noteweave.plans import registry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_health_counts_mentions_of_missing_notes(spark, tmp_path):
    for name in ("documents", "part", "lineitem", "embeddings", "customer"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    orders = pq.read_table(f"{SF}/orders.parquet")
    pq.write_table(orders.slice(3), tmp_path / "orders.parquet")
    gone = set(orders.slice(0, 3)["o_orderkey"].to_pylist()) | {k for k in orders["o_orderkey"].to_pylist() if k % 97 == 0}
    lines = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).to_pylist()
    want = len({(r["l_orderkey"], r["l_partkey"]) for r in lines if r["l_orderkey"] in gone})
    assert want > 0 and registry.QUERIES["health_report"](spark, str(tmp_path)).first()["orphaned_entities"] == want


def test_every_row_is_voted_on_and_decided(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    norm = {r["vec_id"]: math.sqrt(sum(x * x for x in r["embedding"])) for r in rows}
    want = {}
    for r in rows:
        near = [(sum(x * y for x, y in zip(r["embedding"], e["embedding"])) / (norm[r["vec_id"]] * norm[e["vec_id"]]), str(e["vec_id"]), str(e["label"])) for e in rows if e is not r]
        top = sorted((n for n in near if n[0] > 0), key=lambda n: (-n[0], n[1]))[:10]
        mass = {}
        for sim, _, label in top:
            mass[label] = mass.get(label, 0.0) + sim
        if top:
            best = max(mass, key=lambda x: round(mass[x], 9))
            want[str(r["vec_id"])] = (best, round(mass[best] / sum(mass.values()), 5))
    got = registry.QUERIES["folder_vote"](spark, SF).collect()
    assert {r["path"]: r["folder"] for r in got} == {p: f for p, (f, _) in want.items()}
    assert all(abs(r["share"] - want[r["path"]][1]) < 2e-5 for r in got)
    assert sorted(r["path"] for r in registry.QUERIES["organize_decisions"](spark, SF).collect()) == sorted(str(r["vec_id"]) for r in rows)
