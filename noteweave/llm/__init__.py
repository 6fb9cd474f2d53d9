"""Training-data operators: fingerprints, packing, token files, token counts, sharding, tool-call
transcripts, source mixing, similarity joins, vector near-duplicates and toxicity scoring."""
