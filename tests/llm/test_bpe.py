"""Byte-level BPE against the tiktoken library, and exact round trips."""

import random

import public_tokenizers as P
import pytest
import tiktoken
from tamis.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    tokens = bpe.read_ranks(PATH)
    ranks = {t: i for i, t in enumerate(tokens)}
    return bpe.Codec(tokens, P.PATTERN, 50), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(both, texts):
    codec, want = both
    n, ids = codec.encode(texts)
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == want.encode_ordinary(t), t[:80]
        at += k
    size, data = codec.decode(n, ids)
    assert data.tobytes() == "".join(texts).encode() and size.tolist() == [len(t.encode()) for t in texts]


def test_corners(both):
    check(both, ["", " ", "\n\n \t x", "it's we'll", "<|endoftext|>", "a" * 3000, "é" * 700, "0123456789" * 90, "\x1c\x1d \x85  x", "   end   ", "日本語のテキスト", "😀👍🏽", "x" * 511 + " " * 600, "\0"])


def test_random_bytes_of_all_planes(both):
    r = random.Random(3)
    ranges = [(0, 128), (0, 256), (0x300, 0x600), (0x2000, 0x2100), (0x4E00, 0x4F00), (0x1F600, 0x1F650)]
    check(both, ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(200))) for _ in range(150)])


def test_heap_and_matrix_agree(both):
    r = random.Random(4)
    codec = both[0]
    for _ in range(20):
        data = "".join(r.choice("theanier éß") for _ in range(400)).replace(" ", "e").encode()
        codec.forget()
        codec.learn([data.decode()])
        assert codec.pool.tolist() == codec.merge_long(data)


def test_frame(spark):
    rows = [(1, "Hello there", "x"), (None, None, "y"), (3, "", "y"), (1, "Hello there", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, PATH, P.PATTERN, decoded=True)
    got = [(r.doc_id, len(r.ids) > 0, bytes(r.decoded)) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, True, b"Hello there"), (None, False, b""), (3, False, b""), (1, True, b"Hello there")], key=str)
    assert bpe.digests(bpe.encode(docs.limit(0), PATH, P.PATTERN, decoded=True)).count() == 0
