"""Mixture-controlled packing: deficit round-robin over source queues fills windows of one length to target token proportions.

Each source is a queue of its documents' token ids, cut into grains. In every round a queue's deficit grows by its share of a window, and its
grains leave while the deficit covers them; what is left is carried into the next round. A deficit only depends on how many tokens of its own
queue left before, so the round of a grain is known from its place in its queue: a grain that ends at the e-th token leaves in the first
round r with r * share * window >= e. Rounds are therefore served by all tasks at once: one distributed sort of grains by round, queue and
place, whose running sum of tokens is cut at every window's length. Deficits cross windows and partitions, since both are cut out of that one order.

A queue that runs dry leaves its share to the others, so every id is packed exactly once. The tokens behind the last full window go to windows of
powers of two; nothing is padded.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.llm.common import keep, ship, slices


@dataclass(frozen=True)
class Options:
    window: int = 2048  # tokens of a sequence
    grain: int = 512  # tokens that a queue sends at once, at most
    end: int = 1  # the id behind each document
    queues: int = 192  # sources with a queue of their own: the largest ones
    shared: int = 64  # queues of all other sources, by hash
    cache: int = 200_000  # pieces of other scripts whose ids a worker remembers


#: A space between two characters that are no white space always begins a token, so texts can be encoded piece by piece.
CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff]) (?=[^\s\u180e\u200b\ufeff])")
#: Characters beyond Latin letters and their punctuation: of others the libraries' Unicode versions may tell letters differently.
BEYOND = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20ac]")
#: The pattern looks ahead for runs of white space only; where no two white spaces meet it says the same without, and is faster.
AHEAD, BLANKS = r"\s+(?!\S)|", re.compile(r"\s\s")


class Encoder:
    """Texts to ids by the `tokenizers` library; strings of special tokens in them are ordinary text. With `ranks`, the same vocabulary as ranks, what is made of
    Latin letters is encoded by tiktoken, which gives the same ids in a quarter of the time."""

    def __init__(self, path: str, ranks: str | None, end: int, cache: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), cache, {}
        self.tokenizer.encode_special_tokens = True
        #: How an id is written: in two bytes where all ids fit.
        self.kind = "H" if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "I"
        self.end, self.plain = array(self.kind, [end]).tobytes(), None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            made = [tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=own, special_tokens={}).encode_ordinary for p in (public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(AHEAD, ""))]
            self.plain = lambda text: made[not BLANKS.search(text)](text)

    def slow(self, piece: str) -> bytes:
        """A piece by the tokenizer itself; those of frequent pieces are remembered."""
        found = self.known.get(piece)
        if found is None:
            found = array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            if len(piece) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[piece] = found
        return found

    def __call__(self, text: str) -> bytes:
        """The ids of a text and the end id."""
        if self.plain and not BEYOND.search(text):
            return array(self.kind, self.plain(text)).tobytes() + self.end
        out, run = [], []
        for i, piece in enumerate(CUT.split(text)):
            piece = " " + piece if i else piece
            if self.plain and not BEYOND.search(piece):
                run.append(piece)
                continue
            if run:
                out.append(array(self.kind, self.plain("".join(run))).tobytes())
                run = []
            out.append(self.slow(piece))
        if run:
            out.append(array(self.kind, self.plain("".join(run))).tobytes())
        return b"".join(out) + self.end


@lru_cache(maxsize=4)
def encoder(*about) -> Encoder:
    """One of a kind for all tasks of a worker."""
    return Encoder(*about)


def encode(docs: DataFrame, path: str, ranks: str | None = None, o: Options = Options()) -> DataFrame:
    """docs (doc_id, text, source) -> row, part, doc_id, source, before (tokens of the same source before it in its part), n, ids (binary: unsigned little-endian
    numbers of two bytes, or of four if the vocabulary needs them). A null text is empty."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, sums, one = TaskContext.get().partitionId(), 0, {}, encoder(path, ranks, o.end, o.cache)
        wide = 2 if one.kind == "H" else 4
        for batch in slices(batches, 2):
            ids = [one("" if t is None else t) for t in batch.column(2).to_pylist()]
            n, before = np.array([len(x) // wide for x in ids], np.int64), []
            for source, k in zip(batch.column(1).to_pylist(), n.tolist(), strict=True):
                before.append(sums.get(source, 0))
                sums[source] = before[-1] + k
            row = (part << 33) + i + np.arange(len(n))
            i += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(n), part, np.int32)), batch.column(0), batch.column(1), pa.array(before, pa.int64()), pa.array(n), pa.array(ids, pa.binary())], ["row", "part", "doc_id", "source", "before", "n", "ids"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, f"row long, part int, doc_id {kinds['doc_id']}, source {kinds['source']}, before long, n long, ids binary")


def queued(tokens: DataFrame, o: Options) -> tuple[DataFrame, int]:
    """Of each source and part its queue, that queue's tokens and where in the queue it starts; and the number of all tokens."""
    spark = tokens.sparkSession
    parts = keep(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-parts")
    sources = parts.groupBy("source").agg(F.sum("n").alias("n"))
    largest = [r[0] for r in sources.orderBy(F.col("n").desc(), F.col("source").asc_nulls_first()).limit(o.queues).select("source").collect()]
    own = spark.createDataFrame([(x, i) for i, x in enumerate(largest)], f"own {dict(tokens.dtypes)['source']}, q int")
    sources = sources.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("own")), "left")
    sources = sources.select("source", "n", F.coalesce("q", o.queues + F.pmod(F.xxhash64("source"), F.lit(o.shared))).cast("int").alias("queue"))
    by = W.partitionBy("queue")
    before = by.orderBy(F.col("source").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    sources = sources.select(F.col("source").alias("s"), "queue", F.sum("n").over(by).alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sources, F.col("source").eqNullSafe(F.col("s")))
    out = keep(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", "size", (F.col("base") + F.col("start")).alias("start")), "packing-queues")
    return out, parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def served(grains: DataFrame) -> DataFrame:
    """grains (round, queue, upto, row, start, length) -> row, start, length and at: their place in the order of rounds, queues and places."""
    grains = grains.repartitionByRange("round", "queue", "upto").sortWithinPartitions("round", "queue", "upto").select("row", "start", "length")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            upto = total + n.cumsum()
            total = int(upto[-1]) if len(n) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n)], ["row", "start", "length", "part", "before"])

    rows = keep(grains.mapInArrow(run, "row long, start long, length long, part int, before long"), "packing-grains")
    parts = rows.groupBy("part").agg(F.sum("length").alias("n"))
    parts = keep(parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")), "packing-offsets")
    return rows.join(parts, "part").select("row", "start", "length", (F.col("base") + F.col("before")).alias("at"))


def pack(docs: DataFrame, path: str, weights: dict[str | None, float] | None = None, o: Options = Options(), ranks: str | None = None) -> DataFrame:
    """docs (doc_id, text, source, any others) -> a row per piece: doc_id, start (ids of its document before it), length, ids (binary: unsigned 32-bit little-endian
    numbers), doc_tokens, sequence_id, offset.

    path: the vocabulary; ranks: the same as ranks, for speed. weights: the target shares of sources in every window while all of them last, those not named getting the least of the shares named; without
    weights every source's share of all tokens, so that all queues end together. Sources beyond the `queues` largest share queues by hash. A source
    is ahead of or behind its target by no more than a grain a queue. Sequences hold `window` tokens each; the last ones powers of two. Documents stand in
    their queue in the table's order; null and empty texts hold only the end id; null and repeated doc_ids are documents of their own; a null source
    is a source; other columns are left out. No rows give none.
    """
    spark = docs.sparkSession
    tokens = keep(encode(docs, path, ranks, o), "packing-tokens")
    queues, total = queued(tokens, o)
    if not total:
        return tokens.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), "ids", F.col("n").alias("doc_tokens"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    share = F.col("size") / F.lit(float(total))
    if weights:
        named = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"k {dict(tokens.dtypes)['source']}, w double")
        queues = queues.join(F.broadcast(named), F.col("s").eqNullSafe(F.col("k")), "left")
        share = F.max(F.coalesce("w", F.lit(min(map(float, weights.values()))))).over(W.partitionBy("queue")) / F.lit(float(sum(weights.values())))
    queues = queues.withColumn("quantum", share * o.window)
    places = tokens.select("row", "source", "part", "before", "n").join(queues, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    grains = places.select("row", "queue", "quantum", "n", (F.col("start") + F.col("before")).alias("place"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(o.grain).cast("long"))).alias("start"))
    grains = grains.withColumn("length", F.least(F.lit(o.grain).cast("long"), F.col("n") - F.col("start"))).withColumn("upto", F.col("place") + F.col("start") + F.col("length"))
    order = served(grains.select(F.ceil(F.col("upto") / F.col("quantum")).alias("round"), "queue", "upto", "row", "start", "length"))
    # full windows, then one for each power of two that the rest is made of
    full, rest = divmod(total, o.window)
    borders = [full * o.window]
    while borders[-1] < total:
        borders.append(borders[-1] + (1 << ((total - borders[-1]).bit_length() - 1)))
    tail = F.array(*(F.lit(b).cast("long") for b in borders))
    sequence = lambda x: F.when(x < borders[0], F.floor(x / o.window)).otherwise(full - 1 + F.size(F.filter(tail, lambda b: b <= x))).cast("long")
    begin = lambda s: F.when(s < full, s * o.window).otherwise(F.get(tail, (s - full).cast("int")))
    cut = order.withColumn("sequence_id", F.explode(F.sequence(sequence(F.col("at")), sequence(F.col("at") + F.col("length") - 1))))
    low = F.greatest(F.col("at"), begin(F.col("sequence_id")))
    high = F.least(F.col("at") + F.col("length"), F.when(F.col("sequence_id") < full, (F.col("sequence_id") + 1) * o.window).otherwise(F.get(tail, (F.col("sequence_id") - full + 1).cast("int"))))
    cut = cut.select("row", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"), "sequence_id", (low - begin(F.col("sequence_id"))).alias("offset"))
    cuts = cut.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))
    kind = dict(docs.dtypes)["doc_id"]

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                cuts = batch.column(2)
                x = [f.to_numpy() for f in cuts.flatten().flatten()]
                owner = np.repeat(np.arange(batch.num_rows), cuts.value_lengths().to_numpy())
                # grains of a document that meet in a sequence side by side are one piece
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (x[2][1:] != x[2][:-1]) | (x[3][1:] != x[3][:-1] + x[1][:-1])
                first = np.flatnonzero(new)
                length = np.add.reduceat(x[1], first)
                owner = pa.array(owner[first])
                # pieces of a document in order of their starts are its ids in order
                ends = length.cumsum() * 4
                texts = zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), strict=True)
                flat = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4") for x, k in texts]).astype("<u4").tobytes()
                ids = pa.array([flat[x:y] for x, y in zip(ends - length * 4, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(x[0][first]), pa.array(length), ids, batch.column(1).take(owner), pa.array(x[2][first]), pa.array(x[3][first])], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    met = tokens.select("row", "doc_id", F.col("n").alias("doc_tokens"), "ids").join(cuts, "row").select("doc_id", "doc_tokens", "cuts", "ids")
    return met.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(packed: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
