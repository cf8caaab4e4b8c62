"""Files written one a row, clean-ups with their counters, listings, manifests, templates."""

import json
import os

import pytest
from pyspark.sql import functions as F
from tamis.functions import text as T
from tamis.operators import catalog, cleanups, documents, search, units
from tamis.sources import files


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf8", newline="").read() for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def test_one_file_a_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/b{i}.md", i, None, "é\n") for i in range(40)] + [("top.md", 1, 2.5, "")], "file string, n int, x double, t string").repartition(5)
    assert files.write_json_files(rows, str(tmp_path)) == 41
    got = tree(tmp_path)
    assert set(got) == {f"a/b{i}.json" for i in range(40)} | {"top.json"}
    assert json.loads(got["a/b7.json"]) == {"file": "a/b7.md", "n": 7, "x": None, "t": "é\n"} and "é" in got["a/b7.json"] and got["top.json"].startswith("{\n")
    back = spark.read.option("recursiveFileLookup", True).option("multiLine", True).json(str(tmp_path))
    assert sorted((r.file, r.n) for r in back.collect()) == sorted((r.file, r.n) for r in rows.collect())


@pytest.mark.parametrize("path", ["../x", "/x", "a/../b", "", None, "a/"])
def test_bad_paths(spark, tmp_path, path):
    with pytest.raises(ValueError):
        files.write_files(spark.createDataFrame([("ok", "t"), (path, "t")], "path string, text string"), str(tmp_path))
    assert tree(tmp_path) == {}


def test_failing_task_leaves_no_half_file(spark, tmp_path):
    """A task that fails after some files leaves whole files only, and running again completes the tree."""
    rows = spark.createDataFrame([(f"f{i}", "x" * 1000) for i in range(20)], "path string, text string").coalesce(1)
    bomb = rows.withColumn("text", F.when(F.col("path") == "f13", F.concat("text", F.raise_error(F.lit("stop")).cast("string"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        files.write_files(bomb, str(tmp_path))
    assert all(t == "x" * 1000 for t in tree(tmp_path).values()) and not any(n.startswith(files.STAGING) for n in os.listdir(tmp_path))
    assert files.write_files(rows, str(tmp_path)) == files.write_files(rows, str(tmp_path)) == {"written": 20}
    assert tree(tmp_path) == {f"f{i}": "x" * 1000 for i in range(20)}
    assert files.write_files(rows.limit(0), str(tmp_path / "none")) == {"written": 0}


FRONT = "---\na: 1/2 “x”\n---\n"


def test_write_back(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", FRONT + "## todo list:\n- 1 1/2 cups\n- salt 1/2\n“q” …\n", 1), ("b/c.md", "plain\n", 1), ("n.md", None, 1)], "file string, text string, changes int")
    before = docs.collect()
    counts = cleanups.write_back(docs, "fractions", str(tmp_path / "f"))
    assert counts == {"written": 2, "files": 3, "changed": 1, "changes": 1}
    assert tree(tmp_path / "f") == {"a.md": FRONT + "## todo list:\n- 1.5 cups\n- salt 1/2\n“q” …", "b/c.md": "plain\n"}
    assert cleanups.write_back(docs, "headers", str(tmp_path / "h"), changed_only=True) == {"written": 1, "files": 3, "changed": 1, "changes": 1}
    assert tree(tmp_path / "h") == {"a.md": FRONT + "## TODO list\n- 1 1/2 cups\n- salt 1/2\n“q” …"}
    assert cleanups.write_back(docs, "punctuation", str(tmp_path / "p")) == {"written": 2, "files": 3, "changed": 1, "changes": 5}
    assert tree(tmp_path / "p")["a.md"] == "---\na: 1/2 \"x\"\n---\n## todo list:\n- 1 1/2 cups\n- salt 1/2\n\"q\" ...\n"
    assert docs.collect() == before
    for rule in cleanups.RULES:
        second = cleanups.cleaned(docs, rule).agg(F.count_if(F.col("changes") > 0), F.sum("changes")).first()
        once = cleanups.write_back(docs, rule, str(tmp_path / ("x" + rule)))
        assert (once["changed"], once["changes"]) == tuple(second)
        assert cleanups.write_back(docs.limit(0), rule, str(tmp_path / ("y" + rule))) == {"written": 0, "files": 0, "changed": 0, "changes": 0}


@pytest.mark.parametrize(("line", "want"), [
    ("- 1 1/2 cups", "- 1.5 cups"), ("- 3/4", "- 0.75"), ("* 1/3 x 2/3", "* 0.333 x 0.667"), ("- 1½ ½ 2 ¼", "- 1.5 0.5 2.25"), ("- 4/2", "- 2"), ("- 1/0 and 1/8", "- 1/0 and 0.125"),
    ("- 1/2 see https://a.b/2022/12 1/4", "- 0.5 see https://a.b/2022/12 0.25"), ("- 1/16", "- 0.062"), ("- 3/16", "- 0.188"), ("- a1/2", "- a1/2"), ("- 1/2x", "- 1/2x"), ("- 100 1/4", "- 100.25"), ("", ""),
])
def test_fractions(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(T.decimals_for_fractions(F.col("x"))).first()[0] == want


def test_candidates(spark):
    lines = {"- 1 x": True, "  *½": True, "+ a": False, "1. 2": False, "-": False, "": False, "-\t3": True}
    got = spark.createDataFrame([(k,) for k in lines], "x string").select("x", T.candidate_item(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == lines


def test_listing_and_kinds(spark, tmp_path):
    for name in ("index.html", "a b/x+y%.css", "z.py", "sw.js", "robots.txt", "big.js", "note.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (3 << 20 if name == "big.js" else 2))
    rows = files.listing(spark, str(tmp_path))
    got = [(r.path, r.kind) for r in rows.withColumn("kind", catalog.asset_kind(F.col("path"), F.col("length"))).collect()]
    assert got == [("a b/x+y%.css", "shell"), ("big.js", None), ("index.html", "page"), ("note.md", None), ("z.py", "source")]
    assert files.listing(spark, str(tmp_path / "none")).count() == 0


def test_staleness(spark):
    docs = lambda *rows: files.digests(spark.createDataFrame(list(rows), "file string, text string"))
    now, then = docs(("a", "1"), ("b", "2"), ("c", None), (None, "x")), docs(("b", "3"), ("c", None), ("d", "4"), (None, "x"))
    assert sorted(map(tuple, files.staleness(now, then).collect())) == [("a", "new"), ("b", "stale"), ("d", "gone")]
    assert files.staleness(now, now).count() == 0


def test_template(spark):
    rows = spark.createDataFrame([("7", "__PAGES__")], "id string, pages string")
    values = {"__BUILD_ID__": F.col("id"), "__PAGES__": F.col("pages")}
    assert files.rendered("a __BUILD_ID__ b __PAGES__ __BUILD_ID__", values, rows).first().text == "a 7 b __PAGES__ 7"
    for wrong in ("a __PAGES__", "__BUILD_ID__ __PAGES__ __OTHER__"):
        with pytest.raises(ValueError):
            files.rendered(wrong, values, rows)


def test_many_patterns(spark):
    """The index picks what the literal form picks, patterns of every shape among them."""
    names = ["whole milk", "Milk", "fresh bread crumbs", "x", "", "brown-sugar", None, "sugar brown", "a.b"]
    patterns = [("*milk*", 1.0), ("milk", 2.0), ("*bread_crumb*", 3.0), ("*fresh*crumb*", 4.0), ("*sugar*brown*", 5.0), ("*brown*sugar*", 6.0), ("*", 7.0), ("a.b", 8.0), ("*b*", 9.0), ("x", 10.0)]
    rows = spark.createDataFrame([(n, 1) for n in names], "name string, ord int").drop("ord")
    table = spark.createDataFrame([(p, i, v) for i, (p, v) in enumerate(patterns)] + [(None, 99, 0.0)], "pattern string, ord int, value double")
    want = {r.name: r.v for r in rows.select("name", units.best_pattern(units.name_key(F.col("name")), patterns)["v0"].alias("v")).collect()}
    assert {r.name: r.value for r in search.most_specific(rows, "name", table).collect()} == want


def test_first_lines(spark):
    lines = [("f", i + 1, x) for i, x in enumerate(["one two three", "a two b", "xone two threex", "", "one two"])] + [("g", 1, "two")]
    probes = [("f", 1, "one two three"), ("f", 2, "ne two thre"), ("f", 3, "two"), ("f", 4, "none"), ("f", 5, "one\ntwo"), ("f", 6, None), ("f", 7, "threex"), ("g", 1, "two"), ("h", 1, "two"), ("f", 8, ""), ("f", 9, "one  two")]
    got = search.first_lines(spark.createDataFrame(lines, "file string, ln int, line string"), spark.createDataFrame(probes, "file string, id int, probe string"))
    assert {(r.file, r.id): r.ln for r in got.collect()} == {("f", 1): 1, ("f", 2): 1, ("f", 3): 1, ("f", 4): None, ("f", 5): None, ("f", 6): None, ("f", 7): 3, ("g", 1): 1, ("h", 1): None, ("f", 8): 1, ("f", 9): None}


def test_file_report(spark):
    docs = spark.createDataFrame([("a", "# A\n\n---\n\n# B\n\n## Ingredients\n\n- 2 g x\n"), ("b", "")], "file string, text string")
    found = spark.createDataFrame([("a", "warning", "w", 5, "m"), ("a", "error", "z", 9, "n"), ("a", "info", "i", None, "o"), ("c", "info", "i", 1, "p")], "file string, severity string, code string, line int, message string")
    rows = documents.file_report(documents.structure(docs), found, F.col("severity") != "info").orderBy("file").collect()
    assert [tuple(r)[:8] for r in rows] == [("a", 2, 3, 2, 1, 1, 1, 1), ("c", 0, 1, 0, 1, 0, 0, 1)]
    assert rows[0].messages == ["error z line 9 n", "warning w line 5 m"]


def test_first_lines_meets_repeated_lines_once(spark):
    """Of a thousand equal lines only one is a candidate for each different probe."""
    lines = [("f", i, "same words here again" if i % 2 else f"other {i}") for i in range(1, 2001)]
    probes = [("f", i, "me words here ag") for i in range(500)] + [("f", 999, "none such there"), (None, 5, "same")]
    frame = lambda rows, more: spark.createDataFrame(rows, f"file string, {more}")
    found = search.first_lines(frame(lines, "ln int, line string"), frame(probes, "id int, probe string"))
    out = {(r.file, r.id): r.ln for r in found.collect()}
    assert out == {("f", i): 1 for i in range(500)} | {("f", 999): None, (None, 5): None}
    kept = spark.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0])
    assert kept.count() == 1001
