"""The pipeline's stages one by one on the smallest table."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from tamis.llm import common

from tests.llm.helpers import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.keep(stage(spark, docs, DATA), "test-stage")
        if name != "tokens":
            assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name == "near duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count() < before.count()
        if name == "personal data":
            assert docs.count() == before.count() and docs.filter("text LIKE '%@%.example.com%'").count() == 0
        if name == "mix":
            assert docs.groupBy("doc_id").count().filter("count > 2").count() == 0
    texts = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect())
    assert sorted(r.decoded_sha256 for r in docs.collect()) == texts and len(corpus_pipeline.STAGES) == 5


CORNER_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, row long, n double, spans string, component_id string"


def corners(spark):
    """Nulls in every column, empty and long texts, repeated rows and names that stages use themselves."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text + " one"), (3, None), (4, ""), (None, text), (None, None), (5, "x " * 30_000), (6, "mail a@b.cd and 1.2.3.4")]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", None if i in (2, None) else "src0", None, "c", 1, 2, 0.5, None, "d") for i, t in rows], CORNER_COLUMNS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_corners(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], corners(spark)
    rows = [tuple(r) for r in stage(spark, docs, DATA).collect()]
    before = [tuple(r) for r in docs.collect()]
    if name == "toxicity":
        assert Counter(rows) == Counter(before)  # nothing here is toxic
    elif name == "near duplicates":
        assert sorted((r[0] is None, r[0] or 0) for r in rows) == [(False, i) for i in (1, 3, 4, 5, 6)] + [(True, 0)] * 2 and set(rows) <= set(before)
    elif name == "personal data":
        want = [(*r[:1], r[1] and r[1].replace("a@b.cd", "<email>").replace("1.2.3.4", "<ip>"), *r[2:4]) for r in before]
        assert Counter(r[:4] for r in rows) == Counter(want) and all(r[4] == (None if r[1] is None else len(r[1])) for r in rows) and {r[5:] for r in rows} == {r[5:] for r in before}
    elif name == "mix":
        assert set(rows) <= set(before) and all(n <= 2 * before.count(r) for r, n in Counter(rows).items())
    else:
        assert len(rows) == len(before)
        empty = [r for r in stage(spark, docs.filter("coalesce(text, '') = ''"), DATA).collect()]
        assert {(r.n_tokens, r.decoded_sha256) for r in empty} == {(0, hashlib.sha256(b"").hexdigest())}
    assert stage(spark, docs.limit(0), DATA).count() == 0
