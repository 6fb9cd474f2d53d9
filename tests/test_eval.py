"""Evaluation ranks each source by itself."""

import pyarrow as pa
import pyarrow.parquet as pq

import noteweave.plans.retrieval
import noteweave.plans.structure  # noqa: F401
from noteweave.plans import registry


def test_each_source_has_its_own_ranks(spark, tmp_path):
    docs = [(i, "hot", "the thing idiot " * 3) for i in range(60)]
    docs += [(100, "cold", "the" + " other" * 30), (101, "cold", "thing idiot"), (102, "cold", "nothing else"), (103, "none", "nothing")]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": s} for i, s, t in docs]), tmp_path / "documents.parquet")
    labels = [(0, 1, 0), (59, 1, 0), (100, 1, 0), (101, 0, 1), (102, 1, 0), (103, 1, 0)]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "quality": q, "toxic": t} for i, q, t in labels]), tmp_path / "labels.parquet")
    got = {r["source"]: (r["recall_5"], r["success_5"], r["first_rank"], r["rr"]) for r in registry.QUERIES["eval_metrics"](spark, str(tmp_path)).collect()}
    assert got == {"hot": (0.5, 1, 1, 1.0), "cold": (0.5, 1, 1, 1.0), "none": (0.0, 0, None, 0.0)}
    summary = registry.QUERIES["eval_summary"](spark, str(tmp_path)).first()
    assert (summary["n"], summary["recall_5"], summary["success_5"], summary["mrr"]) == (3, 0.33333, 0.66667, 0.66667)
