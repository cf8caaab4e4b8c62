"""Queries that parse many rows of a small file deal them over tasks; what is read many times is made once."""

import os

import pytest
from pyspark.sql import functions as F
from tamis.operators import documents, search
from tamis.plans import queries
from tamis.plans.queries import QUERIES
from tamis.sources.stages import kept

DATA = os.environ.get("TAMIS_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """20,000 rows a table, in one file each."""
    d = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(1, 20_001).coalesce(1)
    rows.select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    rows.select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{d}/part.parquet")
    rows.select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["block_kinds", "section_routing", "item_parts"])
def test_rows_are_dealt(spark, many, capsys, name):
    QUERIES[name](spark, many).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_roundtrip_reads_what_it_made(spark, capsys):
    QUERIES["markdown_roundtrip"](spark, DATA).explain()
    out = capsys.readouterr().out
    assert "roundtrip-lines" in out and "MapInArrow" not in out.split("roundtrip-lines")[0]


PAGES = [(f"f{i}", "# T\n\n## Ingredients for Glaze\n\n- 2 g salt ☃\n- 3 eggs\n- 7/x\n- 1 lb stone (3 kg)\n\n## Notes\n\nGives about 12 cookies\n\n```\nsecret lost words here\n```\n") for i in range(7)] + [("g", "# A\n\nx y\n\n---\n\n# B\n\n- 9-inch pans of tin\n")]


def test_findings_broadcast_nothing_of_the_files(spark, capsys):
    """Files are packed many times smaller than their rows, so their size tells Spark to broadcast what no driver holds."""
    docs = spark.createDataFrame(PAGES, "file string, text string")
    rows = kept(documents.structure(docs), "test-lines")
    for found in (documents.dropped(docs, rows), documents.inferred_yields(rows), documents.components(rows), *documents.sections(rows)):
        found.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_probes_beyond_a_bound_are_not_broadcast(spark, capsys, monkeypatch):
    lines = spark.createDataFrame([("f", i, f"a w{i % 3} common word {i % 5} z") for i in range(40)] + [(None, 1, "a")], "file string, ln int, line string")
    probes = spark.createDataFrame([("f", 1, "w1 common"), ("f", 2, "a w2 common word 4 z"), ("f", 3, "none such here"), ("f", 4, None), ("g", 5, "z")], "file string, id int, probe string")
    few = sorted(search.first_lines(lines, probes).collect())
    monkeypatch.setattr(search, "FEW", 0)
    monkeypatch.setattr(search, "LINES", 8)
    many = search.first_lines(lines, probes)
    many.explain()
    assert "Broadcast" not in capsys.readouterr().out and sorted(many.collect()) == few == [("f", 1, 1), ("f", 2, 14), ("f", 3, None), ("f", 4, None), ("g", 5, None)]


@pytest.mark.parametrize("few", [0, 100])
def test_findings_are_the_same_however_dealt(spark, monkeypatch, few):
    docs = spark.createDataFrame(PAGES, "file string, text string")
    key = lambda r: (r.file, r.code, r.title or "", r.message, r.context or "", r.line or 0, r.rec or 0)
    one = sorted(documents.all_findings(docs).collect(), key=key)
    assert {r.code for r in one} >= {"non-ascii-character", "yield-inferred", "source-content-dropped", "component-without-directions", "conversion-discrepancy", "quantity-unparsed"}
    monkeypatch.setattr(documents, "parts", lambda _: 3)
    monkeypatch.setattr(documents, "FEW", few)
    assert sorted(documents.all_findings(docs).collect(), key=key) == one


def test_texts_are_gathered_in_dealt_tasks(spark, many, capsys, monkeypatch):
    """Tasks that gather orders into texts grow in number, not in rows."""
    monkeypatch.setattr(queries, "GATHERED", 4096)
    QUERIES["section_routing"](spark, many).explain()
    plan = capsys.readouterr().out
    gather = plan[plan.rindex("collect_list") :]
    assert "hashpartitioning(file" in gather and "5), REPARTITION_BY_NUM" in gather and "ENSURE_REQUIREMENTS" not in gather
