"""Packing: ids against the library on whole texts, pieces against what a sequence has to be, shares against their targets."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tamis.llm import packing
from tokenizers import Tokenizer

from tests.llm.helpers import documents, texts

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["a  b", " a", "a ", "a\n b", "a \n b", "a᠎ b", "  b c", "<|endoftext|> x <|endoftext|>", "it's 'll x", "  x y", "x\x1c y", "x \x85 y", "é 日本 語  12 3,4 ...", " ", "  ", "﻿ a b", "🙂 🙂x"]


def whole(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]


def check(spark, docs, rows, o=packing.Options(), weights=None, ranks=RANKS):
    got = packing.digests(packing.pack(docs, PATH, weights, o, ranks)).collect()
    want = sorted((i if i is not None else -1, ids) for (i, _), ids in zip(rows, whole(rows), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[-1 if r.doc_id is None else r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, pieces in by_doc.items():
        lists = [ids for j, ids in want if j == i]
        assert sum(r.length for r in pieces) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                part = np.array(lists[0][at : at + r.length], "<u4")
                assert r.start == at and r.doc_tokens == len(lists[0]) and r.ids_crc32 == zlib.crc32(part.tobytes())
                at += r.length
    assert set(by_doc) == {i for i, _ in want}
    assert set(by_sequence) == set(range(len(by_sequence)))
    lengths = []
    for _, pieces in sorted(by_sequence.items()):
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        lengths.append(at)
    full = sum(lengths) // o.window
    assert lengths[:full] == [o.window] * full and all(n & (n - 1) == 0 and n < o.window for n in lengths[full:]) and len(set(lengths[full:])) == len(lengths[full:])
    return got


def test_ids_and_pieces(spark):
    rows = [*texts(), *((20_000 + i, x) for i, x in enumerate(ODD)), (7, "again"), (7, "again"), (None, "no id")]
    check(spark, documents(spark, rows).repartition(5), rows)
    check(spark, documents(spark, rows), rows, packing.Options(window=64, grain=7, queues=2, shared=1, cache=10), ranks=None)


def test_encoder():
    """Both ways to encode against the library on whole texts: corners and random text of several planes."""
    r = random.Random(3)
    pools = ["ab Z'09.,  \t\n", "aé ßñ“”–… 1", "а я Ж 語日ー ́ x", "".join(map(chr, range(0x20, 0x250))), "".join(chr(r.randrange(0x110000)) for _ in range(300)).encode("utf8", "ignore").decode() + "  "]
    texts = [x for x in ODD] + ["".join(r.choice(p) for _ in range(r.randrange(60))) for p in pools for _ in range(400)]
    for ranks in (RANKS, None):
        one = packing.Encoder(PATH, ranks, 1, 50)
        assert [np.frombuffer(one(t), one.kind).tolist() for t in texts] == whole([(0, t) for t in texts])


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0, "src2": 2.0, None: 2.0}])
def test_shares(spark, weights):
    """While all sources last, each window has their target shares but for two grains of each queue; what is behind is carried on."""
    rows = [(i, f"word{i % 13} and more of it " * (1 + i * 7 % 90)) for i in range(1, 400)]
    o = packing.Options(window=1024, grain=64)
    docs = documents(spark, rows).repartition(4)
    got = check(spark, docs, rows, o, weights)
    source = {r.doc_id: r.source for r in docs.collect()}
    total = defaultdict(int)
    for r in got:
        total[source[r.doc_id]] += r.length
    aim = weights or total
    share = {s: aim[s] / sum(aim.values()) for s in total}
    lasting = int(min(total[s] / share[s] for s in total)) // o.window - 1
    assert lasting > 5
    taken = defaultdict(int)
    for k in range(lasting):
        for r in (r for r in got if r.sequence_id == k):
            taken[source[r.doc_id]] += r.length
        for s in total:
            assert abs(taken[s] - share[s] * o.window * (k + 1)) <= 64 * (len(total) + 1)


def test_same_every_time(spark):
    docs = documents(spark)
    rows = lambda: sorted(map(tuple, packing.digests(packing.pack(docs, PATH)).collect()), key=repr)
    assert rows() == rows()


def test_empty(spark):
    none = documents(spark, []).limit(0)
    assert packing.digests(packing.pack(none, PATH)).count() == 0
