"""Documents to findings, end to end."""

import pytest
from pyspark.sql import functions as F
from tamis.functions import text as T
from tamis.operators import documents

CASES = {
    "clean": ("# T\nServes 4\n\n## Ingredients\n\n- 2 cups flour\n- 1 oz salt (28 g)\n\n## Method\n\n1. Stir for 5 minutes\n", []),
    "count": ("# T\n\n## Ingredients\n\n- 3 eggs\n\n## Method\n\n1. Stir\n", ["implicit-count-unit"]),
    "headless": ("# T\n\n- 2 cups flour\n\n1. Bake at 180°C (100 degrees F)\n", ["no-section-headings", "section-inferred", "section-inferred", "temperature-discrepancy"]),
    "conflict": ("# T\n\n## Ingredients\n\n- 1 lb stone (3 kg)\n- 9-inch pans\n- 7/x\n", ["conversion-discrepancy", "dimension-not-quantity", "missing-directions-section", "quantity-unparsed"]),
    "lost": ("# T\n\n## Ingredients\n\n- 2 g salt\n\n## Method\n\n1. Stir\n\n```\nsecret lost words here\n~~~\nand more words\n```\n", ["source-content-dropped"]),
    "parts": ("# T\n\n## Ingredients for Glaze\n\n- 2 g salt\n\n## Method\n\n1. Stir\n", ["component-without-directions"]),
    "yield": ("# T\n\n## Ingredients\n\n- 2 g sugar\n\n## Method\n\n1. Bake\n\n## Notes\n\nGives about 12 cookies\n", ["yield-inferred"]),
    "odd": ("# T\n\n## Ingredients\n\n- 2 g salt ☃☃\n\n## Method\n\n1. Stir\n", ["non-ascii-character"]),
    "thousands": ("# T\n\n## Ingredients\n\n- 1,000g flour\n\n## Method\n\n1. Stir\n", ["ingredient-name-empty", "quantity-unparsed"]),
    "nothing": (None, []),
}


def test_findings(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "file string, text string")
    rows = documents.all_findings(docs).collect()
    got = {k: sorted(r.code for r in rows if r.file == k) for k in CASES}
    assert got == {k: want for k, (_, want) in CASES.items()}
    assert {r.severity for r in rows if r.code == "quantity-unparsed"} == {"error"}
    lost = next(r for r in rows if r.code == "source-content-dropped")
    assert lost.line == 11 and len(lost.detail) >= 2


def test_dropped_lines(spark):
    """Each record vouches for its own lines only; comments and link definitions are meant to go."""
    text = "# A\n\nonly here words\n\n<!-- a\nnote -->\n[x]: http://y.z\n\n---\n\n# B\n\nother words\n\n```\nonly here words\n```\n"
    docs = spark.createDataFrame([("f", text)], "file string, text string")
    lost = documents.dropped(docs, documents.structure(docs)).orderBy("ln").collect()
    assert [(r.rec, r.title, r.ln) for r in lost] == [(2, "B", 15), (2, "B", 16), (2, "B", 17)]


def test_spans_given_up(spark):
    """A file whose breaks do not tell its records is compared as a whole: what one record says vouches for the lines of another."""
    text = "# A\n\nonly here words\n\n---\n\nB\n===\n\n```\nonly here words\n```\n"
    docs = spark.createDataFrame([("f", text), ("g", "```\nlost words\n```\n")], "file string, text string")
    lost = documents.dropped(docs, documents.structure(docs)).orderBy("file", "ln").collect()
    assert [(r.file, r.rec, r.title, r.ln) for r in lost] == [("f", None, None, 10), ("f", None, None, 12), ("g", None, None, 1), ("g", None, None, 2), ("g", None, None, 3)]


@pytest.mark.parametrize(("line", "name", "modifier"), [("- [mornay](../b.md) using parmesan, optional", "mornay", "using parmesan"), ("- [Custard](c.md) powder", "Custard powder", None), ("- 2 cups flour, sifted", "flour", "sifted"), ("- 2 inch piece of ginger", "ginger", None), ("- 6 inch tortillas", "inch tortillas", None)])
def test_item_clauses(spark, line, name, modifier):
    docs = spark.createDataFrame([("f", f"# T\n\n## Ingredients\n\n{line}\n")], "file string, text string")
    row = documents.ingredients(documents.structure(docs)).first()
    assert (row.name, row.modifier) == (name, modifier) and row.optional == ("optional" in line)


def test_text_rules(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one(T.temperatures, "350 degrees F, 180 deg C") == ["350°F", "180°C"] and one(T.normalised, "all-purpose **x**") == "all purpose x"
    assert one(T.without_comment_text, "a<!-- x\ny -->b\nc") == "a\nb\nc" and one(T.content_of, "| a | b |") == " a b "
    assert one(lambda x: T.first_line(F.split(x, "\n"), F.lit("b")), "a\nab\nb") == 2
    rows = documents.report(spark.createDataFrame([("f", "error"), ("f", "info"), ("g", "info")], "file string, severity string")).first()
    assert (rows.files, rows.errors, rows.warnings, rows.infos, rows.failed) == (2, 1, 0, 2, True)
