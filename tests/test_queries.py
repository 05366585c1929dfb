"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidebar import queries, queries_more

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and b is not None:
        return math.isclose(a, float(b), rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(queries_more.ORACLES))
def test_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    theirs = duck.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    key = lambda row: tuple(str(x) for x in row if not isinstance(x, float) and x is not None)
    ours = sorted((tuple(r) for r in found.collect()), key=key)
    theirs = sorted(theirs, key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (found.columns, a, b)
