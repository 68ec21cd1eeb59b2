"""Queries of this subpackage that have SQL, against it on the smallest tables."""

import math

import duckdb
import pytest

from tallymark.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
