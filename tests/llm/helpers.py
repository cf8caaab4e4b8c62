"""Small tables for the tests of this folder."""

import os

import duckdb

DATA = os.environ.get("TAMIS_TEST_DATA", "/root/testdata/sf0.001")

#: Corners that every operator on documents has to stand: (doc_id, text).
CORNERS = [
    (9001, None), (9002, ""), (9003, " \t\n\x0b\x0c\r "), (9004, "one"), (9005, "one two"), (9006, "x" * 5000), (9007, "a b c " * 4000),
    (9008, "a b c\n" * 300), (9009, "Same line\nsame line\n\nSame line"), (9010, "Same line\nsame line\n\nSame line"), (9011, "\0\x85\xa0  \x1c 日本 語"),
]


def texts():
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()
    return rows + CORNERS


def documents(spark, rows=None, more=()):
    """documents with two extra columns of clashing names."""
    rows = texts() if rows is None else rows
    langs = ["en", "de", "fr", "es", None, "xx"]
    return spark.createDataFrame([(i, t, langs[(i or 0) % 6], f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "n", 1.5) for i, t in [*rows, *more]], "doc_id long, text string, lang string, source string, n_chars long, id string, n double")
