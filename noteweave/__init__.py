"""Noteweave: retrieval, entity-graph, typed-record and corpus operators on PySpark DataFrames."""
