"""The block classifier on CommonMark's corners, captured lists and quotes, and Markdown written and read again."""

import time

import pytest
from tamis.functions.markdown import SILENT, classify
from tamis.operators import blocks

CASES = {
    "fence by length": ("````\n```\n# h\n````\n# h", [("code", ""), ("code", ""), ("code", ""), ("code", ""), ("heading", "h")]),
    "fence by sign": ("```\n~~~\n```x\n```\nt", [("code", "")] * 4 + [("text", "t")]),
    "open fence": ("```\n# h", [("code", ""), ("code", "")]),
    "comment": ("<!-- ## a\n- b\n-->\n- c", [("html", "")] * 3 + [("item", "c")]),
    "html": ("<div>\n# x\n\n# y", [("html", ""), ("html", ""), ("blank", ""), ("heading", "y")]),
    "tag in a paragraph": ("a\n<b>\nc", [("text", "a"), ("text", "<b>"), ("text", "c")]),
    "indented": ("    code\n\nx\n    y", [("code", ""), ("blank", ""), ("text", "x"), ("text", "y")]),
    "setext": ("a\nb\n---\nc\n\n---", [("heading", "a\nb"), ("under", "b"), ("under", ""), ("text", "c"), ("blank", ""), ("break", "")]),
    "more lines": ("- a\n  b\nlazy\n\n  c\n- d", [("item", "a\nb\nlazy c"), ("more", ""), ("more", ""), ("blank", ""), ("more", ""), ("item", "d")]),
    "empty items": ("- \n- a\n-\n\n  b", [("mark", ""), ("item", "a"), ("mark", ""), ("blank", ""), ("text", "b")]),
    "late text": ("-\n  a\n- <!-- c -->", [("mark", ""), ("item", "a"), ("html", "")]),
    "no list": ("a\n2. b\n* \n1. c", [("text", "a"), ("text", "2. b"), ("text", "*"), ("item", "c")]),
    "lost": ("- a\n  > q\n  # h\n  b", [("item", "a b"), ("lost", ""), ("lost", ""), ("more", "")]),
    "quote": ("> a\nb\n> # c\n\nd", [("quote", "a"), ("quote", "b"), ("quote", "c"), ("blank", ""), ("text", "d")]),
    "table": ("x\n| a | b |\n|:--|--:|\n| 1 |\n# h", [("text", "x"), ("row", "| a | b |"), ("rule", ""), ("row", "| 1 |"), ("heading", "h")]),
    "no table": ("| a | b |\n|---|\n", [("text", "| a | b |"), ("text", "|---|")]),
    "definition": ("[a]: http://b\n[//]: # (c)\n\n[a] b", [("definition", ""), ("definition", ""), ("blank", ""), ("text", "[a] b")]),
    "tabs": ("-\ta\n\tb\n#\tc", [("item", "a\nb"), ("more", ""), ("heading", "c")]),
    "breaks": ("***\n- - -\n_ _ _x", [("break", ""), ("break", ""), ("text", "_ _ _x")]),
    "nothing": ("", []),
}


@pytest.mark.parametrize("name", CASES)
def test_kinds(name):
    text, want = CASES[name]
    got = [(r[1], r[3]) for r in classify(text)]
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [b for k, b in got if k not in SILENT] == [b for k, b in want if k not in SILENT]


def test_depth_and_lists():
    rows = classify("1. a\n   - b\n     - c\n2. d\n\n- e\n* f\n")
    assert [(r[3], r[4], r[5], r[6]) for r in rows if r[1] == "item"] == [("a", 0, True, 1), ("b", 1, True, 1), ("c", 2, True, 1), ("d", 0, True, 1), ("e", 0, False, 6), ("f", 0, False, 7)]
    assert [(r[3], r[4]) for r in classify("- - a\n- b") if r[1] == "item"] == [("a", 1), ("b", 0)]
    assert len([r for r in classify("- " * 500 + "x") if r[1] == "item"]) == 1


@pytest.mark.parametrize("line", ["```", "- x", "> x", "<!-- x", "| a |", "word", "    x", "- - - x"])
def test_linear(line):
    """A file of 100,000 lines of a kind is a matter of seconds."""
    began = time.perf_counter()
    assert len(classify(f"{line}\n" * 100_000)) == 100_000
    assert time.perf_counter() - began < 20


def frame(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t, 1) for i, t in enumerate(texts)], "file string, text string, kind int")


def test_captured(spark):
    text = "- a\n  b\n\n  - c\n\npara\n\n1. x\n\n> q\n> - r\nlazy\n\n> s\n"
    rows = blocks.classified(frame(spark, text, None, ""))
    assert [(r.block, r.ordered, r.text) for r in blocks.lists(rows).orderBy("block").collect()] == [(1, False, "- a\n  b\n\n  - c"), (8, True, "1. x")]
    assert [(r.block, r.text) for r in blocks.quotes(rows).orderBy("block").collect()] == [(10, "q r lazy"), (14, "s")]


def test_rows_of_html_and_code_make_no_record(spark):
    rows = blocks.routed(blocks.classified(frame(spark, "# A\n\n---\n\n```\n# no\n```\n\n# B\n\n---\n\n<div>\n", "```\nx\n```")))
    got = {(r.file, r.rec, r.title) for r in rows.collect()}
    assert got == {("f0", 1, "A"), ("f0", 2, "B")}


def test_written(spark):
    text = "# T\n\nServes 4\nand more\n\n## Ingredients for Glaze:\n\n* a\n  * b\n* c\n  d\n\n| x | y |\n|---|---|\n| 1 |\n| \\| | z |\n\n> q\n> r\n\n### Sub\n\n1. go\n2. on\n\n---\n\n# U\n\nend\n"
    first = blocks.routed(blocks.classified(frame(spark, text)))
    told = spark.createDataFrame([("f0", 1, "Serves 4"), ("f0", 2, "9 loaves")], "file string, rec int, yield string")
    out = {r.rec: r.text for r in blocks.written(first, told).collect()}
    assert out[1] == "# T\n\nServes 4\nand more\n\n## Ingredients for Glaze\n\n* a\n* b\n* c\n  d\n\n| x | y |\n| --- | --- |\n| 1 |  |\n| \\| | z |\n\n> q r\n\n### Sub\n\n1. go\n2. on\n"
    assert out[2] == "# U\n\n9 loaves\n\nend\n"
    again = {r.rec: r.text for r in blocks.written(blocks.routed(blocks.classified(frame(spark, out[1])))).collect()}
    assert again[1] == out[1]
