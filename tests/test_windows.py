"""Windows over groups split into stretches, against plain Python."""

import itertools
import random

from tamis.operators import catalog, windows


def runs_of(places, tolerance):
    out = []
    for p in sorted(places):
        if out and p - out[-1][1] <= tolerance:
            out[-1] = (out[-1][0], p, out[-1][2] + 1)
        else:
            out.append((p, p, 1))
    return out


def test_islands(spark):
    r = random.Random(1)
    rows = [(k, r.randrange(-40, 200)) for k in ("a", "b", None) for _ in range(60)] + [("a", None), ("a", None), ("c", 5), ("c", 5)]
    df = spark.createDataFrame(rows, "k string, at long")
    for width in (1, 3, 16, 1000):
        got = sorted((x.k or "", x.first, x.last, x.n) for x in windows.islands(df, ["k"], "at", 2, width).filter("first IS NOT NULL").collect())
        want = sorted((k or "", *run) for k in ("a", "b", "c", None) for run in runs_of([p for x, p in rows if x == k and p is not None], 2))
        assert got == want
    nulls = windows.islands(df, ["k"], "at", 2, 3).filter("first IS NULL").collect()
    assert [x.n for x in nulls] == [1, 1]
    assert windows.islands(df.limit(0), ["k"], "at").count() == 0


def test_deltas(spark):
    r = random.Random(2)
    rows = [(k, at, r.randrange(100)) for k in ("a", None) for at in r.sample(range(-50, 90), 40)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    for width in (1, 7, 1000):
        out = windows.with_undelta(windows.with_delta(df, ["k"], "at", "v", "d", width), ["k"], "at", "d", "back", width).collect()
        assert sorted((x.k or "", x.at, x.v) for x in out) == sorted((k or "", at, v) for k, at, v in rows)
        assert all(x.back == x.v for x in out)
        for k in ("a", None):
            own = sorted((x.at, x.v, x.d) for x in out if x.k == k)
            assert [x[2] for x in own] == [own[0][1], *(b[1] - a[1] for a, b in itertools.pairwise(own))]
    assert windows.with_delta(df.limit(0), ["k"], "at", "v", "d").count() == 0


def test_medians(spark):
    rows = [("a", v) for v in (5.0, 1.0, 1.0, 9.0)] + [("b", 2.0), ("b", None), (None, 3.0), ("c", None)]
    got = {x.k: (x.median, x.worst) for x in catalog.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": (5.0, 9.0), "b": (2.0, 2.0), None: (3.0, 3.0), "c": (None, None)}
