"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import noteweave.plans.maintenance
import noteweave.plans.retrieval
import noteweave.plans.structure
import noteweave.plans.vaults  # noqa: F401
from noteweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    return "~" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
