"""Whitening against NumPy on whole matrices."""

from fractions import Fraction

import numpy as np
import pytest
from tamis.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], SCHEMA).repartition(3)


def check(spark, rows):
    rng = np.random.default_rng(2)
    got = whitening.whiten(frame(spark, rows)).collect()
    kept = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = {(i, tuple(v)): [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in kept}
    fit = sorted(set(map(tuple, x.values())))
    n, mean = len(fit), [Fraction(sum(c), len(fit)) for c in zip(*fit, strict=True)]
    d = np.array([[float(a - m) for a, m in zip(v, mean, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(16, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(kept) * k and {r.component for r in got} == set(range(1, k + 1))
    by_id = {}
    for (i, _), v in x.items():
        by_id.setdefault(i, v)
    sign = {}
    for r in sorted(got, key=lambda r: r.component):
        own = by_id[r.vec_id]
        assert r.n == n and r.deviation == sum(int((n * a - n * m) ** 2) for a, m in zip(own, mean, strict=True))
        want = float(np.array([float(a - m) for a, m in zip(own, mean, strict=True)]) @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1]))
        if abs(want) > 1e-3:
            sign.setdefault(r.component, np.sign(want * r.whitened))
        assert abs(sign.get(r.component, 1) * r.whitened - want) < 1e-6
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-4
    return rng


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20)) @ np.diag(np.linspace(0.3, 3, 20))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20), (904, [float("inf")] * 20)]
    check(spark, rows + bad + [(5000 + i, rows[3][1]) for i in range(200)])


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(50, 3)))])
    line = whitening.whiten(frame(spark, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (None, [4.0, 4.0])])).collect()
    assert [r.component for r in line] == [1, 1, 1] and {r.vec_id for r in line} == {1, 2, None}


def test_corners(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0 == whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count()
    mixed = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [0.0, 5.0]), (3, [1.0])])).collect()
    assert {r.vec_id for r in mixed} == {1, 2}
    far = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])])).collect()
    assert len(far) >= 3 and all(r.deviation is None for r in far if r.vec_id != 3)


@pytest.mark.parametrize("big", [False, True])
def test_exact_integers(big):
    """Both forms of integers say the same, up to where 64 bits end."""
    x = np.array([[5, 1 << 61], [7, -(1 << 61)], [9, 3]] if big else [[5, 6], [7, 8], [9, 3]], np.int64)
    sums = whitening.exact_sums(x)
    assert sums == [21, 3] if big else sums == [21, 17]
    d = whitening.centred(x, 3, sums)
    assert [[int(v) for v in r] for r in d] == [[3 * int(a) - s for a, s in zip(r, sums, strict=True)] for r in x]
    want = [sum(int(v) ** 2 for v in r) for r in d]
    assert whitening.deviations(d) == [w if w < 1 << 63 else None for w in want]
