"""LM scoring: the tree against a recursive one, probabilities that sum to 1, counts against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tamis.llm import lm

from tests.llm.helpers import documents, texts


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1000.5, 1e8])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)


def plain_tree(train, contexts):
    """log10 of the next byte's probability after DEPTH bytes, by the definition, from dictionaries."""
    n, seen = Counter(), Counter()
    for t in train:
        d = b"\xff" * lm.DEPTH + t + b"\xff"
        for i in range(lm.DEPTH, len(d)):
            for depth in range(lm.DEPTH + 1):
                seen[d[i - depth : i]] += 1
                for k in range(8):
                    n[d[i - depth : i], d[i] >> (8 - k) | 1 << k, d[i] >> (7 - k) & 1] += 1
    del seen[b""]
    tree = {c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:contexts]}
    inner = {c[1:] for c in tree} | {b""}
    nodes = {(c, x) for c, x, _ in n if c in tree or not c}
    two = {(c, x): (n[c, x, 0], n[c, x, 1]) for c, x in nodes}
    pooled = {k: list(v) for k, v in two.items() if k[0] in inner}
    for c, x in nodes:
        if c:
            for bit in (0, 1):
                pooled[c[1:], x][bit] -= two[c, x][bit]
    below = {k: kt(*v) for k, v in pooled.items()}
    for depth in range(lm.DEPTH, 0, -1):
        for c, x in nodes:
            if len(c) == depth:
                own = kt(*two[c, x])
                below[c[1:], x] += np.logaddexp(own, below[c, x]) - math.log(2) if c in inner else own

    def after(c, d, x):
        """The probability of a one at node x of the d last bytes of c."""
        own = c[len(c) - d :]
        n0, n1 = two.get((own, x), (0, 0))
        one = (n1 + 0.5) / (n0 + n1 + 1)
        if own not in inner:
            return one
        if d < lm.DEPTH and c[len(c) - d - 1 :] in tree:
            deep = after(c, d + 1, x)
        else:
            p0, p1 = pooled.get((own, x), (0, 0))
            deep = (p1 + 0.5) / (p0 + p1 + 1)
        w = 1 / (1 + math.exp(min(700, max(-700, below.get((own, x), 0.0) - kt(n0, n1)))))
        return w * one + (1 - w) * deep

    def log10(c, b):
        p = [after(c, 0, b >> (8 - k) | 1 << k) for k in range(8)]
        return sum(math.log10(x if b >> (7 - k) & 1 else 1 - x) for k, x in enumerate(p))

    return log10


@pytest.mark.parametrize("contexts", [1 << 16, 200])
def test_against_plain_tree(spark, contexts):
    rows = [(i, t) for i, t in texts() if i % 9 == 0 and len(t or "") < 600] + [(77, None), (78, "Öde ñ"), (None, "no id")]
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    log10 = plain_tree(train, contexts)
    out = {r.doc_id: r for r in lm.score(documents(spark, rows), contexts=contexts).collect()}
    assert len(out) == len(rows)
    words = Counter(w for t in train for w in [*t.lower().split(), b""])
    total, distinct = sum(words.values()), len(words)
    for i, t in rows:
        d, r = b"\xff" * lm.DEPTH + (t or "").encode() + b"\xff", out[i]
        assert r.score == pytest.approx(sum(log10(d[j - lm.DEPTH : j], d[j]) for j in range(lm.DEPTH, len(d))), rel=1e-5)
        own = [*(t or "").encode().lower().split(), b""]
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(words[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in own))


def test_rare_words_are_joined(spark, monkeypatch):
    rows = [(i, t) for i, t in texts() if len(t or "") < 3000]
    want = {r.doc_id: r for r in lm.score(documents(spark, rows)).collect()}
    monkeypatch.setattr(lm, "LISTED", 7)
    for r in lm.score(documents(spark, rows)).collect():
        assert r.n_known == want[r.doc_id].n_known and r.base_score == pytest.approx(want[r.doc_id].base_score)


def test_probabilities_sum_to_one(spark):
    names, table = lm.train(lm.counts(documents(spark)).filter("gram IS NOT NULL").select("gram", "n"), 500)
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4) and len(names) == 500 and len(table) == 501


def test_held_out_texts_are_coded_well(spark):
    rows = [r for r in lm.score(documents(spark, [x for x in texts() if x[0] < 9000])).collect() if r.held_out]
    assert np.median([r.bits_per_byte for r in rows]) < 4


def test_nothing_to_learn(spark):
    assert lm.score(documents(spark, []).limit(0)).count() == 0
    r = lm.score(documents(spark, [(i, "ab") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:1])).first()
    assert r.score == pytest.approx(-24 * math.log10(2)) and r.n_known == 0 and r.train_tokens == 0


def many_contexts():
    """Texts that hold more than the 65,536 contexts to which the tree was once cut."""
    rng = random.Random(5)
    return [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.,é") for _ in range(1000))) for i in range(44)]


@pytest.mark.parametrize("listed", [1 << 21, 3000, 0])
def test_no_context_is_left_out(spark, monkeypatch, listed):
    """The whole tree, with all grams listed, most of them joined, all of them joined."""
    monkeypatch.setattr(lm, "GRAMS", listed)
    rows = [*many_contexts(), (9001, None), (9002, ""), (None, "no id")]
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    padded = [b"\xff" * lm.DEPTH + t + b"\xff" for t in train]
    assert len({d[i - n : i] for d in padded for i in range(lm.DEPTH, len(d)) for n in range(1, lm.DEPTH + 1)}) > 1 << 16
    log10 = plain_tree(train, 1 << 40)
    out = {r.doc_id: r for r in lm.score(documents(spark, rows)).collect()}
    assert len(out) == len(rows) and any(r.held_out for r in out.values())
    for i, t in rows:
        d = b"\xff" * lm.DEPTH + (t or "").encode() + b"\xff"
        assert out[i].score == pytest.approx(sum(log10(d[j - lm.DEPTH : j], d[j]) for j in range(lm.DEPTH, len(d))), rel=1e-9)
