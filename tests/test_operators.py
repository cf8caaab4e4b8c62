"""Operators on literal cases with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F
from tamis.functions import numbers as N
from tamis.functions import text as T
from tamis.operators import blocks, catalog, findings, grammar, units
from tamis.sources import files


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values)))
    return df.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(("text", "value"), [("3", 3.0), ("2.5", 2.5), ("1/4", 0.25), ("1 1/2", 1.5), ("2¾", 2.75), ("½", 0.5), ("~4", 4.0), ("1-2", 1.5), ("3 to 5", 4.0), ("1–3", 2.0), ("1-2-3", 1.75), ("1/0", None), ("some", None), ("", None)])
def test_quantity(spark, text, value):
    assert one(spark, N.quantity, text) == value


@pytest.mark.parametrize(("a", "text"), [(2.0, "2"), (0.333333, "0.333"), (1234.5, "1234.5")])
def test_plain(spark, a, text):
    assert one(spark, N.plain, a) == text


def test_intervals(spark):
    gap = lambda *v: one(spark, N.interval_gap, *map(float, v))
    assert gap(1, 2, 2, 3) == 0 and gap(1, 2, 4, 8) == 0.25 and gap(4, 8, 1, 2) == 0.25
    assert one(spark, N.interval_text, 10.0, 10.0) == "10.0g" and one(spark, N.interval_text, 10.0, 20.25) == "10.0-20.2g"


@pytest.mark.parametrize(
    ("line", "value", "unit"),
    [("2 tbsp oil", 2.0, "tablespoon"), ("2x 300g spinach", 600.0, "gram"), ("2 x 20 cm tins", None, None), ("500g-750g rice", 625.0, "gram"), ("1 heaped tsp salt", 1.5, "teaspoon"), ("6-pound pumpkin", 6.0, "pound"), ("9-inch ginger", None, None), ("2 inch ginger", 2.0, "inch"), ("2 inch thick ginger", None, None), ("3 lemons", 3.0, "count"), ("5% milk", None, None), ("4 in rounds", None, None), ("salt", None, None)],
)
def test_term(spark, line, value, unit):
    t = one(spark, lambda x: grammar.term(x, True), line)
    assert (t and t.value, t and t.unit) == (value, unit)


def test_item(spark):
    lines = ["- 2 cups [mornay](../b.md), grated (optional)", "* 1 cup + 2 tbsp milk (270 g)", "- salt", "", None, "- 2 cans (15 oz each) beans"]
    rows = grammar.item(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"), "line").orderBy("i").collect()
    assert (rows[0].name, rows[0].modifier, rows[0].optional, rows[0].link) == ("mornay", "grated", True, "../b.md")
    assert rows[1].name == "+ 2 tbsp milk" and [t.unit for t in rows[1].amounts] == ["cup", "tablespoon"] and [a.text for a in rows[1].alternatives] == ["270 g"]
    assert rows[2].name == "salt" and rows[2].amounts == [] and rows[3].name is None and rows[4].name is None and rows[5].amounts[0].nested.value == 15.0 and rows[5].name == "beans"


def test_patterns_and_grams(spark):
    best = lambda name: one(spark, lambda x: units.best_pattern(units.name_key(x), [("*fresh*crumb*", 1), ("*bread_crumb*", 2), ("bread", 3), ("*a*", 4)]), name)
    assert [best(n) and best(n).v0 for n in ("fresh bread crumbs", "fresh crumb", "bread", "oil")] == [2, 1, 3, None]
    g = lambda v, u, k, n: one(spark, lambda a, b, c, d: units.grams(a, b, c, d), v, u, k, n)
    assert g(2.0, "cup", "volume", "olive oil").value == pytest.approx(436.8) and g(1.0, "can", "piece", "tomato") is None
    assert g(2.0, "count", "piece", "eggs").hi == 126.0 and g(1.0, "inch", "length", "ginger") is None and g(3.0, "minute", "duration", "x").value == 0.0


def test_text(spark):
    assert one(spark, T.temperatures, "at 180°C (350 F)") == ["180°C", "350°F"] and one(spark, T.durations, "30-40 minutes, 1 hr") == [2400, 3600]
    assert one(spark, T.strip_comments, "a <!-- x\ny --> b\n[//]: # (note)\n") == "a  b" and one(spark, T.lines, "a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, T.wrap_urls, "see http://x.y/z. [a](http://x.y)") == "see <http://x.y/z>. [a](http://x.y)"
    assert one(spark, T.clean_header, "## todo list:") == "## TODO list" and one(spark, T.url_path, "a%b#c?") == "a%25b%23c%3F"
    assert one(spark, lambda x: T.bigrams(T.tokens(T.normalised(x))), "**The** big (cat)!") == ["the big", "big cat"]


def test_structure(spark):
    text = "Title\n=====\nServes 4\n\n## Ingredients for Glaze:\n- a\n- Optional:\n  - b\n- c\n\n| x | y |\n|---|---|\n| 1 |\n\n## Method\n1. go\n\n---\n# Two\n- i\n1. d\n- n\n"
    rows = blocks.routed(blocks.classified(spark.createDataFrame([("f", text), ("g", None)], "file string, text string")))
    items = blocks.items(rows).orderBy("ln").collect()
    assert [(r.rec, r.body, r.section, r.component, r.group_optional) for r in items] == [(1, "a", "ingredients", "Glaze", False), (1, "b", "ingredients", "Glaze", True), (1, "c", "ingredients", "Glaze", False), (1, "go", "directions", "Main", False), (2, "i", "ingredients", None, False), (2, "d", "directions", None, False), (2, "n", "notes", None, False)]
    assert [r.cells for r in blocks.tables(rows).orderBy("ln").collect()] == [["x", "y"], ["1", ""]]
    assert blocks.yields(rows).collect()[0]["yield"] == "Serves 4" and {r.title for r in rows.collect()} == {"Title", "Two"}
    assert [r.code for r in findings.missing_sections(rows).collect()] == ["no-section-headings"]


def test_conflicts(spark):
    df = spark.sql("select struct(100D as lo, 100D as hi) a, struct(10D as lo, 10D as hi) b, 10 as n")
    assert df.select(findings.mass_conflict(F.col("a"), F.col("b")).alias("x")).first().x == 0.9
    assert df.select(findings.mass_conflict(F.col("a"), F.col("b"), F.col("n"), F.lit(False)).alias("x")).first().x is None
    many = one(spark, lambda x: findings.rendered(F.lit("info"), F.lit("c"), x, F.array(*(F.lit(str(i)) for i in range(14)))), "m")
    assert many.startswith("[INFO] c: m") and many.endswith("... and 2 more")


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿---\nserves: 4\n---\n# T\n", encoding="utf-8")
    (tmp_path / "index.md").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b's.MD").write_text("---\nopen\n")
    rows = files.frontmatter(files.corpus(spark, [str(tmp_path)])).orderBy("file").collect()
    assert [(r.metadata, r.body) for r in rows] == [('{"serves": 4}', "# T\n"), (None, "---\nopen\n")]
    (tmp_path / "d.csv").write_text("pattern,density\n*oil*,0.9\nbad,x\n*oil*,0.8\n")
    assert files.densities(spark, str(tmp_path / "d.csv")) == [("*oil*", 0.8)] and files.densities(spark, None)[3] == ("water", 1.0)
    import struct

    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert files.densities(spark, str(tmp_path / "none.csv")) == files.densities(spark, str(tmp_path / "bad.csv")) == files.densities(spark, None)
    assert files.corpus(spark, [str(tmp_path / "none")]).count() == 0 and files.corpus(spark, [str(tmp_path / "none"), str(tmp_path)]).count() == len(rows)
    (tmp_path / "short.bin").write_bytes(struct.pack("<7i", 0, 0, -2, 0, 0, 0, 24) + b"\0" * 24)
    with pytest.raises(Exception, match="not as long as its header says"):
        files.star_records(spark, str(tmp_path / "short.bin")).collect()
    (tmp_path / "s.bin").write_bytes(struct.pack("<7i", 0, 0, -1, 0, 0, 0, 24) + struct.pack("<fdd2sh", 1.0, 3.141592653589793, 0.5, b"G2", 150))
    star = files.star_records(spark, str(tmp_path / "s.bin")).first()
    assert (star.ra, star["class"], star.mag) == (180.0, "G2", 1.5)
    (tmp_path / "g.json").write_text('{"features":[{"id":"Ori","geometry":{"coordinates":[[[-10.0,5.0],[20.0,6.0]]]}}]}')
    assert [(r.pos, r.ra) for r in files.features(spark, str(tmp_path / "g.json")).orderBy("pos").collect()] == [(0, 350.0), (1, 20.0)]
    near = catalog.snapped(spark.createDataFrame([(1, 359.999, 0.0), (2, 90.0, 0.0)], "point long, ra double, dec double"), spark.createDataFrame([(7, 0.001, 0.0)], "star long, ra double, dec double"))
    assert [(r.point, r.star) for r in near.collect()] == [(1, 7)]


def test_snapped_looks_at_places_and_high_declinations(spark, capsys):
    """Points and stars of one place meet once; near the pole half a degree spans many degrees of right ascension."""
    points = [(i, 10.0, 0.25) for i in range(300)] + [(1000, 10.0, 89.0), (1001, 359.9, -60.0), (1002, 5.0, 0.0), (1003, 5.0, None)]
    stars = [(i, 10.0, 0.25) for i in range(5, 205)] + [(900, 30.0, 89.0), (901, 0.5, -60.0), (902, 5.0, 0.5), (903, 5.0, 0.6)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, ra double, dec double")
    out = {r.point: (r.star, round(r.sep, 3)) for r in catalog.snapped(frame(points, "point"), frame(stars, "star"), 0.5).collect()}
    assert all(out[i] == (5, 0.0) for i in range(300)) and out[1000] == (900, 0.349) and out[1001] == (901, 0.3) and out[1002] == (902, 0.5) and 1003 not in out
