"""The queries of this package that SQL can express against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from tamis.llm.queries import ORACLES, QUERIES

from tests.llm.helpers import DATA


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got, rel = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    want = [tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)
