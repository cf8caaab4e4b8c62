"""The Jaccard join against all pairs by brute force."""

import random

import numpy as np
import pytest
from tamis.llm import graph, jaccard

from tests.llm.helpers import documents, texts


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_table(spark, k, num, den):
    rows = texts()
    assert got(jaccard.classes(documents(spark), k, num, den)) == brute(rows, k, num, den)


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = "new" + str(r.randrange(10**6))
    return " ".join(w)


@pytest.mark.parametrize("leaf", [3, 40, 128])
def test_large_group_of_near_copies(spark, monkeypatch, leaf):
    """More copies than a leaf holds, with chains of links, so that document pivots and borders are used."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    r = random.Random(leaf)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = [(i, edited(r, base, r.randrange(6))) for i in range(150)]
    far = [f"w{r.randrange(500)}" for _ in range(120)]
    rows += [(1000 + i, edited(r, base[: 120 - 5 * i] + far[: 5 * i], 0)) for i in range(24)]
    rows += [(2000 + i, " ".join(f"u{i}x{j}" for j in range(60)) + " " + " ".join(base[:50])) for i in range(80)]
    assert got(jaccard.classes(documents(spark, rows), 3, 9, 10)) == brute(rows, 3, 9, 10)


def test_keys(spark):
    """Null keys, repeated rows, and a key with two texts."""
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "e f g h"), (5, "e f g h"), (7, None)]
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.classes(documents(spark, rows), 3, 9, 10).collect())
    assert [x for x in out if x[0] == "None"] == [("None", 2, "None")] and ("7", 0, "7") in out and len(out) == 6
    assert jaccard.classes(documents(spark, rows).limit(0), 3, 9, 10).count() == 0


def test_components(spark):
    links = [(9, 8), (8, 7), (7, 6), (1, 9), (20, 21), (21, 22), (5, 5), (30, 20)]
    out = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in out} == {9: 1, 8: 1, 7: 1, 6: 1, 1: 1, 20: 20, 21: 20, 22: 20, 30: 20}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (4, 5)])
def test_linked_sets_meet(num, den):
    """Whatever the sizes, two sets within the threshold have as many regions in common as both count on."""
    rng = np.random.default_rng(num)
    shared = 0
    for _ in range(3000):
        n = int(np.exp(rng.uniform(0, 6.5))) + 1
        a = rng.integers(-(2**63), 2**63, n)
        gone, new = rng.integers(0, jaccard.reach(n, num, den) + 2, 2)
        b = np.unique(np.concatenate([a[gone:], rng.integers(-(2**63), 2**63, new)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if den * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            shared += 1
            (x, p), (y, q) = jaccard.signatures(a, num, den), jaccard.signatures(b, num, den)
            band = max((len(np.intersect1d(u, v)), i, j) for i, u in enumerate(x) for j, v in enumerate(y))
            assert band[0] >= max(p[band[1]], q[band[2]]) >= 1
    assert shared > 300


def test_links_come_from_pivots_and_leaves(spark, monkeypatch):
    """Groups larger than a leaf take pivots, smaller ones are compared at once; both kinds give links."""
    monkeypatch.setattr(jaccard, "LEAF", 16)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = [(i, edited(r, base, r.randrange(4))) for i in range(60)] + [(100 + i, edited(r, [f"v{i // 2}x{j}" for j in range(80)], 1)) for i in range(12)]
    out, pivots, leaves = jaccard.classed(documents(spark, rows), 3, 9, 10)
    assert got(out) == brute(rows, 3, 9, 10) and pivots.count() > 30 and leaves.count() >= 1


def test_key_with_two_texts_links_both(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    out = jaccard.classes(documents(spark, [(5, one), (5, two), (3, one + " more"), (9, two + " more"), (7, one + " more")]), 3, 9, 10)
    assert {r.component_id for r in out.collect()} == {3}
