"""Queries of this folder that have SQL, against DuckDB."""

import os

import duckdb
import pytest

from palaver.llm.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark):
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    res = c.execute(ORACLES[name])
    cols = [x[0] for x in res.description]
    want = sorted(map(str, res.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, DIR).select(*cols).collect()) == want and want
