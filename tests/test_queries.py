"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallymark.plans import oracle, registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        f = f"{DIR}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    want = con.sql(oracle.SQL[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
