"""Classifier chains: held-out accuracy, the chain itself, and corners."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tamis.llm import toxicity

from tests.llm.helpers import documents

BAD = ["zork", "blarg", "fnord"]


def rows(n, seed, start=0):
    r = random.Random(seed)
    out, said = [], []
    for i in range(n):
        toxic, low = r.random() < 0.2, r.random() < 0.3
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(20, 120))]
        for bad in r.sample(BAD, r.randrange(1, 3)) if toxic else ():
            w[r.randrange(len(w))] = bad.upper() if r.random() < 0.3 else bad
        if low:
            w += ["junk"] * 3
        out.append((start + i, " ".join(w)))
        said.append((start + i, int(low), int(toxic if r.random() > 0.02 else not toxic), "extra"))
    return out, said


def test_held_out(spark):
    train, said = rows(1200, 1)
    held, want = rows(600, 2, 5000)
    labels = spark.createDataFrame([*said, (3, None, 1, "x"), (999999, 1, 1, "x")], "doc_id long, low int, toxic int, text string")
    docs = documents(spark, train + held)
    out = {r.doc_id: r for r in toxicity.classify(docs, labels, ("low", "toxic")).collect()}
    assert len(out) == 1800
    truth = {i: any(b in t.lower().split() for b in BAD) for i, t in held}
    assert all(out[i].rejected == truth[i] for i in truth)
    assert np.mean([(out[i].p_low > 0.5) == bool(low) for i, low, *_ in want]) > 0.97
    left = toxicity.clean(docs, labels, ("low", "toxic"))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in out.items() if not r.rejected}


def test_later_model_uses_earlier_probability():
    model = toxicity.Model(("a",), ("x", "y"), (np.array([4.0, -2.0]), np.array([0.0, 6.0, -3.0])))
    p = model.chances([np.array([0]), np.array([], int)])
    assert p[0, 0] == pytest.approx(1 / (1 + np.exp(-2))) and p[0, 1] == pytest.approx(1 / (1 + np.exp(3 - 6 * p[0, 0]))) and p[1, 1] < 0.2


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (x @ [1, -2, 0, 0.5] + rng.normal(size=300) > 0).astype(float)
    w = toxicity.logistic(x, y, 0.5)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 0.5 * w[:-1]).max() < 1e-5 and toxicity.logistic(x, np.ones(300), 0.5)[:-1].any() == False  # noqa: E712


def test_corners(spark):
    none = spark.createDataFrame([], "doc_id long, low int, toxic int")
    docs = documents(spark)
    out = toxicity.classify(docs, none, ("low", "toxic"))
    assert out.count() == docs.count() and out.filter(F.col("p_toxic") != 0.5).count() == 0
    assert toxicity.classify(docs.limit(0), none, ("low", "toxic")).count() == 0
    assert toxicity.clean(docs, spark.createDataFrame([(9001, 0, 0), (9002, 0, 0)], "doc_id long, low int, toxic int"), ("low", "toxic")).count() == docs.count()
