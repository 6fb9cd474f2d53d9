"""The subpackage's registered queries and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from noteweave.llm import embedding_dups, fingerprints, mixing, ngram_join, packing, sharding, token_counts, token_files, tool_calls, toxicity

QUERIES = {
    "op1_fingerprint": fingerprints.op1_fingerprint,
    "op2_pack": packing.op2_pack,
    "op3_token_files": token_files.op3_token_files,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_shard": sharding.op5_shard,
    "op6_tool_calls": tool_calls.op6_tool_calls,
    "op7_mix": mixing.op7_mix,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_embedding_dups": embedding_dups.op9_embedding_dups,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op6_tool_calls": tool_calls.OP6_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
