"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Each pre-token is a row of byte ids; rows of like length share a padded matrix. In each round every open row merges its leftmost pair of
least rank, all rows at once: the rank of a pair comes from an open-addressing hash table over pairs of ids, the merged row is compacted
to the left, and rows without a mergeable pair leave the matrix. Pre-tokens found are remembered per worker, up to a fixed number.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import ship, slices

NONE = np.int32(2**31 - 1)
#: Code points that the regex library counts as letters or numbers, but the vocabularies' own library, by an older Unicode, doesn't.
NEWER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 "
    "AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
NEWER_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"


def read_ranks(path: str) -> list[bytes]:
    """A .tiktoken file (a base64 token and its rank on each line) as a list of tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def pre_tokens(pattern: str) -> Callable[[str], list[str]]:
    """text -> its pre-tokens. Texts with letters or numbers of a newer Unicode take the pattern with those taken out of its classes."""
    ranges = lambda x: "".join("-".join(rf"\U{int(y, 16):08X}" for y in r.split("-")) for r in x.split())
    letters, numbers = ranges(NEWER_LETTERS), ranges(NEWER_NUMBERS)
    plain, newer = regex.compile(pattern).findall, regex.compile(f"[{letters}{numbers}]").search
    exact = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]"), regex.V1).findall
    return lambda text: plain(text) if text.isascii() or not newer(text) else exact(text)


def gather(starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of each, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    index = np.arange(ends[-1], dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return pool[index]


class Codec:
    """Ranks made ready for encoding and decoding. Worker-side; memory is bounded by the vocabulary and `most` remembered pre-tokens."""

    LONG = 512  # bytes; longer rows are merged by a heap, whose cost does not grow with the square of the row

    def __init__(self, tokens: list[bytes], pattern: str, most: int = 400_000):
        self.split = pre_tokens(pattern)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.single = self.byte.tolist()
        pairs = {(rank[t[:i]], rank[t[i:]]): r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        self.pairs = pairs
        self._hash(pairs)
        self.most = most
        self.forget()

    def _hash(self, pairs: dict) -> None:
        """An open-addressing table of at most half its slots filled; collisions go on to the next slot."""
        self.bits = max(4, (2 * len(pairs) + 1).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values, left = np.fromiter(pairs.values(), np.int32, len(pairs)), np.arange(len(pairs))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            placed, first = np.unique(slot[left[free]], return_index=True)
            done = left[free][first]
            self.keys[placed], self.ranks[placed] = keys[done], values[done]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to; NONE where it doesn't merge or either is padding (-1)."""
        keys = a.astype(np.int64) << 32 | b
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        flat, res = keys.ravel(), out.ravel()
        slot = self._slot(flat[todo])
        while len(todo):
            here = self.keys[slot]
            hit = here == flat[todo]
            res[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (here >= 0)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return res.reshape(keys.shape)

    def merge(self, rows: np.ndarray) -> np.ndarray:
        """Padded rows (-1 behind each) of byte ids -> the same rows merged, padded likewise."""
        out, who = rows.copy(), np.arange(len(rows))
        ranks = self.rank_of(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        while len(who) and ranks.shape[1]:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            open_ = best < NONE
            if not open_.all():
                done = ~open_
                out[who[done], : rows.shape[1]] = rows[done]
                out[who[done], rows.shape[1] :] = -1
                who, rows, ranks, at, best = who[open_], rows[open_], ranks[open_], at[open_], best[open_]
                if not len(who):
                    break
            i, width = np.arange(len(who)), rows.shape[1]
            rows[i, at] = best
            cols = np.arange(width - 1)
            rows = np.take_along_axis(rows, cols + (cols > at[:, None]), 1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), width - 2), 1)
            if width > 2:
                for p in (at - 1, at):
                    ok = np.flatnonzero((p >= 0) & (p < width - 2))
                    ranks[ok, p[ok]] = self.rank_of(rows[ok, p[ok]], rows[ok, p[ok] + 1])
        if len(who):
            out[who, : rows.shape[1]] = rows
            out[who, rows.shape[1] :] = -1
        return out

    def merge_long(self, data: bytes) -> list[int]:
        """One long row, by a heap of (rank, place) over a linked list: the same merges in the same order."""
        ids = [self.single[b] for b in data]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pairs.get((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := pairs.get((ids[p], r))) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x >= 0]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.n, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        """Encodes pre-tokens and remembers them."""
        data = [x.encode() for x in new]
        size = np.fromiter(map(len, data), np.int64, len(data))
        counts, parts, order = [], [], []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32), (32, 64), (64, 128), (128, 256), (256, self.LONG)):
            bucket = np.flatnonzero((size > low) & (size <= high))
            for own in np.array_split(bucket, max(1, len(bucket) * high // 4_000_000)):
                if not len(own):
                    continue
                width = int(size[own].max())
                inside = np.arange(width) < size[own][:, None]
                rows = np.full(inside.shape, -1, np.int32)
                rows[inside] = self.byte[np.frombuffer(b"".join(data[i] for i in own), np.uint8)]
                rows = self.merge(rows)
                kept = rows >= 0
                order.append(own), counts.append(kept.sum(1)), parts.append(rows[kept])
        for i in np.flatnonzero(size > self.LONG):
            ids = self.merge_long(data[i])
            order.append(np.array([i])), counts.append(np.array([len(ids)])), parts.append(np.array(ids, np.int32))
        n, base = np.concatenate(counts).astype(np.int64), len(self.at)
        self.at = np.concatenate([self.at, np.cumsum(n) - n + len(self.pool)])
        self.n, self.pool = np.concatenate([self.n, n]), np.concatenate([self.pool, *parts])
        self.known.update(zip((new[i] for i in np.concatenate(order).tolist()), range(base, base + len(n)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids one after the other."""
        pieces = [self.split(t) for t in texts]
        flat = [p for ps in pieces for p in ps]
        if len(self.known) > self.most:
            self.forget()
        if new := [p for p in set(flat) if p not in self.known]:
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        n, row = self.n[which], np.repeat(np.arange(len(texts)), [len(ps) for ps in pieces])
        return np.bincount(row, n, len(texts)).astype(np.int64), gather(self.at[which], n, self.pool)

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes each list of ids has, and all bytes one after the other."""
        n = self.lengths[ids]
        row = np.repeat(np.arange(len(counts)), counts)
        return np.bincount(row, n, len(counts)).astype(np.int64), gather(self.starts[ids], n, self.bytes)


_made: list = []


def _codec(shared) -> Codec:
    """This worker's codec for a broadcast vocabulary; it holds one at a time."""
    if not _made or _made[0] is not shared.value:
        _made[:] = [shared.value, Codec(*shared.value)]
    return _made[1]


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """docs -> key, ids (array of int) and, if asked for, decoded (binary, made from the ids). A row for each row.

    ranks: the path of a .tiktoken file, read on the driver; its tokens (bounded by the vocabulary) are broadcast. A null text is empty and
    gives no ids. Each match of the pattern is encoded by itself; there are no special tokens, so their strings are ordinary text. Texts of
    any length are encoded whole. Needs every single byte in the vocabulary.
    """
    spark = docs.sparkSession
    ship(spark)
    tokens = read_ranks(ranks)
    if missing := set(range(256)) - {t[0] for t in tokens if len(t) == 1}:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    shared = spark.sparkContext.broadcast((tokens, pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in slices(batches, 1, 2_000_000):
            n, ids = codec.encode([x or "" for x in batch.column(1).to_pylist()])
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            out = [batch.column(0), pa.ListArray.from_arrays(offsets(n), pa.array(ids))]
            if decoded:
                size, data = codec.decode(n, ids)
                out.append(pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, offsets(size).buffers()[1], pa.py_buffer(data.tobytes())]))
            yield pa.RecordBatch.from_arrays(out, [key, "ids", "decoded"][: len(out)])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """encoded (with decoded) -> key, n_tokens, ids_sha256, decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
