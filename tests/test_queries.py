"""Every registered query of the parsing and quality operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from tamis.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TAMIS_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def row(values):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = [row(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    have = [row(r[c] for c in columns) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
