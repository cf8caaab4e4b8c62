"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional codebooks. The codebooks start as residual k-means of a bounded sample
and are then refitted together by least squares on beam-searched codes. Every vector is encoded by beam search and stored as its codes and
the norm of its reconstruction. Queries look their inner products with all codewords up in tables, a score is the sum of a table entry for
each codebook over the stored norm, and the best candidates are ranked again exactly on the original vectors.

How many candidates that takes depends on the vectors, so no fixed number is ranked. Each vector keeps how far its reconstruction's direction lies
from its own; what that remainder can add to a score is read off the candidates that were ranked already, and all vectors that can
still reach the k-th best score by it are ranked too, until none is left. So near copies of one vector, whose codes are alike, and vectors that all look
one way are ranked in full where their codes can't tell them apart. Of exact copies only those with the least keys can be near to anything.

Queries against all rows go in blocks: slabs of codes and vectors meet blocks of queries, a pair of both in a task, each of a fixed size. A task tells
each query's k best of its slab.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.llm.common import keep, ship


@dataclass(frozen=True)
class Options:
    books: int = 12
    words: int = 128  # in a codebook
    sample: int = 8_000  # vectors to fit on, at most: those whose ids have the least hashes
    beam: int = 4
    rerank: int = 80  # candidates of a slab that are ranked exactly before it is known what can still be near
    margin: float = 2.0  # standard deviations of a random direction's part, added to what remainders were seen to add
    slab: int = 16_384  # codes in a task; fewer where vectors are longer than 64
    block: int = 8_192  # queries in a task, likewise
    chunk: int = 256  # queries whose tables are made at once
    seed: int = 5


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def beam_codes(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """x (n, d), books (m, k, d) -> codes (n, m) and the norms of their sums: per codebook the `beam` sums nearest to x go on."""
    n, (m, k, d) = len(x), books.shape
    residual, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for j in range(m):
        far = (residual**2).sum(-1)[..., None] - 2 * residual @ books[j].T + (books[j] ** 2).sum(-1)
        flat = far.reshape(n, -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, 1)[:, :width]
        parent, word = best // k, best % k
        residual = np.take_along_axis(residual, parent[..., None], 1) - books[j][word]
        codes = np.concatenate([np.take_along_axis(codes, parent[..., None], 1), word[..., None].astype(np.uint8)], 2)
    best = (residual**2).sum(-1).argmin(1)[:, None]
    codes = np.take_along_axis(codes, best[..., None], 1)[:, 0]
    found = x - np.take_along_axis(residual, best[..., None], 1)[:, 0]
    return codes, np.sqrt((found**2).sum(1))


def fit(x: np.ndarray, o: Options) -> np.ndarray:
    """Codebooks (m, k, d) from a sample of unit vectors."""
    rng, residual, books = np.random.default_rng(o.seed), x.astype(np.float32), []
    for _ in range(o.books):
        books.append(kmeans(residual, o.words, rng).astype(np.float32))
        residual = residual - books[-1][((books[-1] ** 2).sum(1) - 2 * residual @ books[-1].T).argmin(1)]
    books = np.stack(books)
    codes, _ = beam_codes(x, books, o.beam)
    size = o.books * o.words
    chosen = codes + np.arange(o.books) * o.words
    normal, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
    for a in range(o.books):
        np.add.at(right, chosen[:, a], x)
        for b in range(o.books):
            np.add.at(normal, (chosen[:, a], chosen[:, b]), 1.0)
    prior = 0.1  # draws codewords that few vectors use to where they were
    new = np.linalg.solve(normal + prior * np.eye(size), right + prior * books.reshape(size, -1))
    return new.reshape(books.shape).astype(np.float32)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in single precision."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", options: Options = Options()) -> DataFrame:
    """vectors (key, vector of one length) -> query_id, rank, key, score: each query's k nearest by cosine among all other rows.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null key. Ties go to the smaller key.
    Rows that repeat a key are rows of their own. Scores are cosines in double precision of the original vectors. Vectors of another length than
    most rows have (of equally frequent lengths the longest) take no part.
    """
    spark, o = vectors.sparkSession, options
    ship(spark)
    kinds = dict(vectors.dtypes)
    single = kinds[vector] == "array<float>"  # is kept so: half the bytes of what is shuffled
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if length is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` {kinds[key]}, score double")
    rows = rows.filter(F.size("v") == length.d)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(o.sample).select("v").toPandas()
    books = spark.sparkContext.broadcast(fit(units(np.array(sample["v"].tolist(), float)), o))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, part in _vectors(batches, 2):
            u = units(x.astype(float))
            codes, norms = beam_codes(u, books.value, o.beam)
            norms = np.maximum(norms, 1e-9)
            along = np.clip(sum((u * books.value[m][codes[:, m]]).sum(1) for m in range(codes.shape[1])) / norms, -1, 1)
            yield pa.RecordBatch.from_arrays([*part.columns, _bytes(codes), pa.array(norms, pa.float32()), pa.array(along, pa.float32())], ["id", "q", "v", "code", "norm", "along"])

    kind = "array<float>" if single else "array<double>"
    coded = rows.select("id", "q", "v").mapInArrow(encode, f"id long, q boolean, v {kind}, code binary, norm float, along float")
    coded = keep(coded.withColumn("row", F.monotonically_increasing_id()), "ann-codes")
    sizes = coded.agg(F.count("*").alias("all"), F.coalesce(F.count_if("q"), F.lit(0)).alias("asked")).first()
    short = max(1, length.d // 64)
    n_slabs, n_blocks = (max(1, -(-n // max(1, most // short))) for n, most in ((sizes["all"], o.slab), (sizes["asked"], o.block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slabs = _packed(coded, n_slabs, "slab", ["id", "row", "norm", "along", "code", "v"]).withColumn("block", every(n_blocks))
    blocks = _packed(coded.filter("q"), n_blocks, "block", ["id", "row", "v"]).withColumn("slab", every(n_slabs))
    pairs = slabs.alias("s").join(blocks.alias("b"), ["slab", "block"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                ids, own, norms, along = (at(c) for c in ("ids", "rows", "norms", "alongs"))
                codes = np.frombuffer(b"".join(batch.column("codes")[i].as_py()), np.uint8).reshape(len(ids), -1)
                x, asked = (batch.column(c)[i].values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for c, n in (("vs", len(ids)), ("q_vs", len(at("q_ids")))))
                first = _few_copies(x, k + 1)
                slab = Slab(ids[first], own[first], norms[first], along[first].astype(float), codes[first], x[first])
                yield from _nearest(slab, at("q_ids"), at("q_rows"), asked, books.value, k, o)

    found = pairs.select("s.ids", "s.rows", "s.norms", "s.alongs", "s.codes", "s.vs", F.col("b.ids").alias("q_ids"), F.col("b.rows").alias("q_rows"), F.col("b.vs").alias("q_vs"))
    near = found.mapInArrow(scan, "query_id long, q_row long, id long, row long, score double")
    by = W.partitionBy("q_row").orderBy(F.col("score").desc(), "id", "row")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


@dataclass(frozen=True)
class Slab:
    """Rows of one task: keys, row numbers, norms of reconstructions, cosines to them, codes and vectors."""

    ids: np.ndarray
    rows: np.ndarray
    norms: np.ndarray
    along: np.ndarray
    codes: np.ndarray
    x: np.ndarray


def _few_copies(x: np.ndarray, most: int) -> np.ndarray:
    """Places of vectors, of equal ones the first `most`."""
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return np.sort(order[nth < most])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up one component after another, so that a row gives the same wherever it stands."""
    return np.add.accumulate(a * b, axis=-1)[..., -1]


def _nearest(s: Slab, ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, books: np.ndarray, k: int, o: Options) -> Iterator[pa.RecordBatch]:
    """Each query's k nearest rows of a slab."""
    size = np.sqrt(_dot(s.x, s.x))
    u = s.x / np.abs(s.x).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    across = np.sqrt(np.maximum(0.0, 1 - s.along**2))
    margin = o.margin / np.sqrt(s.x.shape[1])
    for start in range(0, len(ids), o.chunk):
        part = asked[start : start + o.chunk]
        q_units = part / np.abs(part).max(1, keepdims=True)
        q_units /= np.sqrt((q_units * q_units).sum(1, keepdims=True))
        tables = np.einsum("qd,mkd->mqk", q_units.astype(np.float32), books, optimize=True)
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, (q, unit, q_id, q_row) in enumerate(zip(part, q_units, ids[start:], rows[start:], strict=False)):
            scores = tables[0, i][s.codes[:, 0]].astype(float)
            for m in range(1, s.codes.shape[1]):
                scores += tables[m, i][s.codes[:, m]]
            scores /= s.norms
            left = s.rows != q_row
            at = np.flatnonzero(left)
            if len(at) > o.rerank:
                at = at[np.argpartition(scores[at], len(at) - o.rerank)[len(at) - o.rerank :]]
            ranked, exact = at[:0], np.zeros(0)
            rest = np.sqrt(np.maximum(0.0, 1 - scores**2))
            while len(at):
                left[at] = False
                ranked, exact = np.concatenate([ranked, at]), np.concatenate([exact, u[at] @ unit])
                least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
                # a remainder's part in a score is at most what lies across both directions, and seldom more than it was seen to be
                seen = ((exact - scores[ranked] * s.along[ranked]) / np.maximum(across[ranked], 1e-6)).max()
                reach = scores * s.along + across * np.minimum(seen + margin, rest) + 1e-5
                at = np.flatnonzero(left & (reach >= least))
            best = ranked[exact >= least - 1e-9] if len(ranked) else ranked
            score = _dot(s.x[best], q) / (np.sqrt(_dot(q, q)) * size[best]) if len(best) else np.zeros(0)
            best = best[(order := np.lexsort((s.rows[best], s.ids[best], -score))[:k])]
            for values, more in zip(out, (np.full(len(best), q_id), np.full(len(best), q_row), s.ids[best], s.rows[best], score[order]), strict=True):
                values.append(more)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "q_row", "id", "row", "score"])


def _vectors(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            yield part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def _packed(rows: DataFrame, parts: int, name: str, columns: list[str]) -> DataFrame:
    """Rows side by side, in order of id and row: name (the part, by hash), and an array of each column, named with an s."""
    made = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias(name)).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("x"))
    return made.select(name, *(F.col(f"x.{c}").alias(c + "s") for c in columns))
