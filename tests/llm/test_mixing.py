"""Mixing: corners against the query's SQL, and rows of the mix against the plan."""

from collections import Counter

import duckdb
import pytest
from tamis.llm import mixing
from tamis.llm.queries import ORACLES, QUERIES

from tests.llm.helpers import documents, texts

REPEATED = [(1, "one two three"), (1, "one two three"), (2, "four"), (2, "other words here"), (None, "no id"), (None, "no id"), (None, "x " * 4000)]


@pytest.mark.parametrize("rows", [REPEATED, [*texts(), *REPEATED], [(5, None), (6, "")], [(i, "same size") for i in range(400)]], ids=["repeated", "corners", "no words", "ties"])
def test_corners_against_sql(spark, tmp_path, rows):
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(ORACLES["op6_mixing"])
    got = QUERIES["op6_mixing"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rel.fetchall(), key=repr)
    assert len(got) == len({i for i, _ in rows}) and all(r.taken <= 2 * r.size for r in got)


def test_mix_follows_the_plan(spark):
    """Every row of an id as often as its unit is taken; sources come near their targets; extra columns stay."""
    docs = documents(spark, [*texts(), *REPEATED])
    sized = docs.select(docs["doc_id"].alias("id"), "source", mixing.word_count(docs["text"]).alias("size"))
    plan = {r.id: r for r in mixing.systematic(sized).collect()}
    before = Counter(map(tuple, docs.collect()))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(map(tuple, out.collect())) == Counter({r: n * plan[r[0]].copies for r, n in before.items() if plan[r[0]].copies})
    for source in {r.source for r in plan.values()}:
        own = [r for r in plan.values() if r.source == source]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 2 * max(r.size for r in own)


def test_empty(spark):
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0
