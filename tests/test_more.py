"""Rules that no other test reaches: findings of sections, scaled alternatives, numbers as text, yields of metadata, orders, names, located lines."""

from pyspark.sql import functions as F
from tamis.functions import numbers as N
from tamis.functions import text as T
from tamis.operators import blocks, catalog, documents, findings, grammar, units, windows


def one(spark, f, *values):
    kinds = {int: "long", float: "double", str: "string"}
    df = spark.createDataFrame([values], ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values)))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first().x


def routed(spark, *texts):
    return documents.structure(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string"))


def test_missing_sections(spark):
    rows = routed(spark, "# A\n\n## Method\n\n1. go\n", "# A\n\n## Ingredients\n\n- x\n", "# A\n\n## Tips\n\n- x\n")
    got = sorted((r.file, r.code) for r in findings.missing_sections(rows).collect())
    assert got == [("f0", "missing-ingredients-section"), ("f1", "missing-directions-section"), ("f2", "missing-directions-section"), ("f2", "missing-ingredients-section")]


def test_alternatives_of_pieces(spark):
    """Three eggs of 44 to 63 g are 150 g, or 50 g each; not 500 g."""
    lines = {"3 eggs (150 g)": False, "3 eggs (50 g each)": False, "3 eggs (500 g)": True, "3 eggs (5 g each)": True}
    items = grammar.item(spark.createDataFrame([(k,) for k in lines], "body string"), "body")
    got = {r.body: r.gap for r in findings.mass_conflicts(items).select("body", "gap").collect()}
    assert set(got) == {k for k, v in lines.items() if v} and all(0 < g < 1 for g in got.values())


def test_numbers_as_text(spark):
    assert [one(spark, N.plain, x) for x in (2.0, 0.3333, 1234.5, 0.1)] == ["2", "0.333", "1234.5", "0.1"]
    assert [one(spark, N.quantity_text, x) for x in ("1 1/2", "~ 3/4", "2-3", "some")] == ["1.5", "~0.75", "2.5", "some"]
    assert one(spark, N.interval_text, 100.0, 100.0) == "100.0g" and one(spark, N.interval_text, 1000.0, 1250.25) == "1000.0-1250.2g"
    assert one(spark, N.relative_difference, 90.0, 100.0) == 0.1 and one(spark, N.celsius, 212.0) == 100.0


def test_yields_of_metadata(spark):
    rows = routed(spark, "# A\n\nServes 4\n", "# B\n\nServes 6\n", "# C\n")
    metadata = spark.createDataFrame([("f0", '{"serves": " 12 "}'), ("f1", '{"title": "x"}'), ("f2", None)], "file string, metadata string")
    assert {(r.file, r["yield"]) for r in blocks.yields(rows, metadata).collect()} == {("f0", "12"), ("f1", "Serves 6")}


def test_findings_in_order_and_located(spark):
    text = "# T\n\nthe 3 eggs of old\n\n## Ingredients\n\n- 3 eggs\n- 1 x ☃\n- 2 lemons\n  for juice\n"
    found = documents.all_findings(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    ranks = [r.emit_ord.producer for r in sorted(found, key=lambda r: tuple(r.emit_ord))]
    assert ranks == sorted(ranks) and {r.emit_ord.producer for r in found} >= {0, 4}
    by = {(r.code, r.context): r for r in found}
    assert by["implicit-count-unit", "3 eggs"].line == 3  # the first line that holds the text
    assert by["implicit-count-unit", "2 lemons\nfor juice"].line is None
    assert "SNOWMAN" in next(r.message for r in found if r.code == "non-ascii-character")
    assert [(r.code, r.n) for r in documents.code_counts(spark.createDataFrame([("f", "b", (1, 0, 0)), ("f", "a", (2, 0, 0)), ("f", "c", (0, 0, 0)), ("g", "c", (0, 0, 0))], "file string, code string, emit_ord struct<producer:int,rec:int,line:int>")).collect()] == [("c", 2), ("b", 1), ("a", 1)]


def test_small_rules(spark):
    assert [(x.image, x.text, x.target) for x in one(spark, T.links, "a [b](c) ![d](e (f) g) [h](<i>)")] == [(False, "b", "c"), (True, "d", "e (f) g"), (False, "h", "<i>")]
    assert [one(spark, catalog.class_bucket, x) for x in ("G2V", " k", "W", "x", "")] == ["G", "K", "O", "A", "A"]
    rows = spark.createDataFrame([(k, i, v) for k, vs in {"a": "xxyx", "b": "xxx", None: "xy"}.items() for i, v in enumerate(vs)], "k string, i int, v string")
    assert sorted(((r.k or "", r.i) for r in windows.polylines(rows, ["k"], [F.col("i")], "v").collect())) == [("", 0), ("", 1), ("a", 0), ("a", 2), ("a", 3)]
    x = one(spark, lambda v: units.weight_details(v, F.lit("inch"), F.lit("length"), F.lit("ginger")), 2.0)
    assert x.value is None and "measures a length" in x.details
