"""Every query with SQL against DuckDB on the smallest tables, compared as sorted rows; none may be vacuous."""

import math
import os

import duckdb
import pytest

from palaver.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


#: No sentence of the tables names a role beside a name; test_operators has sentences that do.
EMPTY = {"person_roles"}


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(v, 5)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(name, spark, duck):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*cols).collect())
    res = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(cell(r[i]) for i in order) for r in res.fetchall())
    assert got == want
    assert got or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, DIR).collect()


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
