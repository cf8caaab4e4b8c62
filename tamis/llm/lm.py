"""LM scoring by context-tree weighting over bytes.

Each byte is decomposed into eight binary decisions. A decision has a node at every depth: no context, the last byte, the last two, up to DEPTH,
each with the bits of this byte so far. A node's Krichevsky-Trofimov estimate comes from its counts in the training texts; the weighting
mixes the estimates of all depths, by how well each would have coded what the nodes below it saw.

The tree holds every context of the training texts and grows with them. Runs of DEPTH + 1 bytes (grams) of all texts are summed in the
workers, then by Spark. Subtrees of the last three bytes of a context are weighted in their own tasks, of which there are more for more
grams; the shorter contexts above them by sums and joins. The model is a table of the log-probability of each gram that any text holds,
learnt or not. A gram that was never learnt has nodes without counts, which leave the mixture of the known ones as it is.

With a number of contexts given, the tree is a pruned one in the workers' memory: it holds that many of the most frequent contexts, and under
a context with longer ones in the tree, one more leaf pools those that are not.

A text is coded from its first byte, behind bytes 255, to an end byte 255, which UTF-8 never uses; so probabilities of all texts sum to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import keep, ship, slices

DEPTH = 5
#: Contexts of so many last bytes head the subtrees that are weighted in one task; a task gets about so many grams.
HEAD, TASK_GRAMS = 3, 250_000
#: Grams scored in the pass over the texts: the most frequent ones, broadcast. All others are joined.
GRAMS = 1 << 21
_PAD = b"\xff" * DEPTH
#: Words counted in the scoring pass itself: the most frequent ones of at most LONGEST bytes, broadcast. All others are joined.
LISTED, LONGEST = 1 << 17, 48
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series eight steps up."""
    y = x + 8.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    steps = np.ones_like(y)
    for i in range(8):
        steps = steps * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(steps)


def bits(counts: np.ndarray) -> np.ndarray:
    """Counts of bytes (..., 256) -> counts of zeros and ones at the 255 nodes of a byte's bits (..., 255, 2), by number of bits so far."""
    shape = counts.shape[:-1]
    return np.concatenate([counts.reshape(*shape, 1 << k, 2, 128 >> k).sum(-1) for k in range(8)], axis=-2)


def log_kt(n: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts of zeros and ones."""
    n = n.astype(np.float64)
    return log_gamma(n[..., 0] + 0.5) + log_gamma(n[..., 1] + 0.5) - math.log(math.pi) - log_gamma(n.sum(-1) + 1.0)


def kt_one(n: np.ndarray) -> np.ndarray:
    return (n[..., 1] + 0.5) / (n.sum(-1) + 1.0)


def byte_log10(one: np.ndarray) -> np.ndarray:
    """Probabilities of a one at the 255 nodes (..., 255) -> log10 of each byte's probability (..., 256)."""
    b, out = np.arange(256), 0.0
    for k in range(8):
        p = one[..., (1 << k) - 1 + (b >> (8 - k))]
        out = out + np.log10(np.where(b >> (7 - k) & 1, p, 1.0 - p))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


class Subtree:
    """All contexts of the tree that end with one byte. rows: depth, ctx (its bytes as a number, the last one lowest), b, n."""

    def __init__(self, rows: pd.DataFrame):
        name = rows["depth"].to_numpy(np.int64) << 48 | rows["ctx"].to_numpy(np.int64)
        self.names, at = np.unique(name, return_inverse=True)
        self.depth, self.ctx = self.names >> 48, self.names & (1 << 48) - 1
        self.counts = np.zeros((len(self.names), 256), np.int64)
        np.add.at(self.counts, (at, rows["b"].to_numpy()), rows["n"].to_numpy())
        short = np.maximum(self.depth - 1, 0)
        self.parent = np.searchsorted(self.names, short << 48 | self.ctx & (1 << 8 * short) - 1)
        self.longer, self.below = np.zeros_like(self.counts), np.zeros((len(self.names), 255))
        self.inner = np.isin(np.arange(len(self.names)), self.parent[self.depth > 1])
        for d in range(int(self.depth.max()), 0, -1):
            own = np.flatnonzero(self.depth == d)
            log = log_kt(bits(self.counts[own]))
            deep = own[self.inner[own]]
            self.below[deep] += log_kt(bits(self.counts[deep] - self.longer[deep]))
            log[self.inner[own]] = np.logaddexp(log[self.inner[own]], self.below[deep]) - math.log(2)
            if d > 1:
                np.add.at(self.below, self.parent[own], log)
                np.add.at(self.longer, self.parent[own], self.counts[own])
        self.weighted = log[0]

    def tables(self, sure: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the bytes' probabilities behind each context. sure, left: at the root's nodes, its share of the mixture and what it leaves."""
        a, b, out = np.zeros_like(self.below), np.zeros_like(self.below), np.zeros(self.counts.shape, np.float32)
        a[0], b[0] = sure, left
        for d in range(1, int(self.depth.max()) + 1):
            own = np.flatnonzero(self.depth == d)
            if d > 1:
                a[own], b[own] = a[self.parent[own]], b[self.parent[own]]
            two = bits(self.counts[own])
            one, weight = kt_one(two), sigmoid(log_kt(two) - self.below[own])
            weight[~self.inner[own]] = 1.0
            pooled = kt_one(bits(self.counts[own] - self.longer[own]))
            out[own] = byte_log10(a[own] + b[own] * (weight * one + (1.0 - weight) * pooled))
            a[own] += b[own] * weight * one
            b[own] *= 1.0 - weight
        return out


def levels(grams: DataFrame) -> list[DataFrame]:
    """(gram, n) of DEPTH + 1 bytes -> for each depth from 0 the same of depth + 1 bytes, each summed from the next longer."""
    out = [grams]
    for d in range(DEPTH - 1, -1, -1):
        gram = F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))
        out.append(keep(out[-1].select(gram.alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams"))
    return out[::-1]


def train(grams: DataFrame, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, n), summed -> the sorted names of the tree's contexts (depth << 48 | ctx) and rows of log10 probabilities, the root's last.

    The driver gets `contexts` names, a row for each last byte, and a row of 1 KB for each context.
    """
    spark, by_depth = grams.sparkSession, levels(grams)
    named = lambda d: by_depth[d].select(F.lit(d).alias("depth"), F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("b"), "n")
    every = reduce(DataFrame.union, map(named, range(1, DEPTH + 1)))
    top = every.groupBy("depth", "ctx").agg(F.sum("n").alias("m")).orderBy(F.col("m").desc(), "depth", "ctx").limit(contexts).select("depth", "ctx")
    top = spark.createDataFrame(top.toPandas(), "depth int, ctx long")  # a context's suffixes are as frequent, and so in it too
    rows = keep(every.join(F.broadcast(top), ["depth", "ctx"]).withColumn("last", F.col("ctx").bitwiseAND(F.lit(255)).cast("int")), "lm-tree")

    def first(group: pd.DataFrame) -> pd.DataFrame:
        tree = Subtree(group)
        return pd.DataFrame({"w": [tree.weighted.tolist()], "n": [tree.counts[0].tolist()]})

    got = rows.groupBy("last").applyInPandas(first, "w array<double>, n array<long>").toPandas()
    counts, flat = np.zeros(256, np.int64), by_depth[0].toPandas()
    counts[flat["gram"].to_numpy(np.int64)] = flat["n"].to_numpy(np.int64)
    longer = np.array(got["n"].tolist(), np.int64).reshape(-1, 256).sum(0)
    below = np.array(got["w"].tolist(), np.float64).reshape(-1, 255).sum(0) + log_kt(bits(counts - longer))
    weight = sigmoid(log_kt(bits(counts)) - below)
    sure, left = weight * kt_one(bits(counts)), 1.0 - weight
    root = byte_log10(sure + left * kt_one(bits(counts - longer))).astype(np.float32)

    def second(group: pd.DataFrame) -> pd.DataFrame:
        tree = Subtree(group)
        return pd.DataFrame({"name": tree.names, "p": [x.tobytes() for x in tree.tables(sure, left)]})

    found = rows.groupBy("last").applyInPandas(second, "name long, p binary").orderBy("name").toArrow()
    table, at = np.empty((found.num_rows + 1, 256), np.float32), 0
    for chunk in found.column("p").chunks:  # copied once, from the buffers they came in
        first = int(np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset]) if len(chunk) else 0
        table[at : at + len(chunk)].ravel()[:] = np.frombuffer(chunk.buffers()[2], np.uint8)[first : first + 1024 * len(chunk)].view(np.float32) if len(chunk) else 0
        at += len(chunk)
    table[-1] = root
    return found.column("name").to_numpy().astype(np.int64), table


class Branch:
    """The nodes of some grams, down from contexts of HEAD bytes. A node's name is its context << 8 | the byte's bits so far behind a one."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        byte, k = (grams & 255)[:, None], np.arange(8)
        self.bit = (byte >> (7 - k) & 1).astype(bool)
        names, up = np.unique(((grams & ~255)[:, None] | (byte | 256) >> (8 - k)).ravel(), return_inverse=True)
        two = np.stack([np.bincount(up, (n[:, None] * side).ravel(), len(names)) for side in (~self.bit, self.bit)], 1)
        log = log_kt(two)
        #: From the deepest on: the places of what is below, the share of each node in the mixture, its estimate.
        self.levels = [(up, np.ones(len(names)), kt_one(two))]
        for d in range(DEPTH - 1, HEAD - 1, -1):
            names, up = np.unique((names >> 8 & (1 << 8 * d) - 1) << 8 | names & 255, return_inverse=True)
            two = np.stack([np.bincount(up, two[:, side], len(names)) for side in (0, 1)], 1)
            log, weight = mixed(two, np.bincount(up, log, len(names)))
            self.levels.append((up, weight, kt_one(two)))
        self.names, self.two, self.log = names, two, log

    def log10(self, sure: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the grams' last bytes. sure, left: at the topmost nodes, what shorter contexts have put in the mixture and left of it."""
        for up, weight, one in self.levels[::-1]:
            sure, left = (sure + left * weight * one)[up], (left * (1.0 - weight))[up]
        sure = sure.reshape(-1, 8)
        return np.log10(np.where(self.bit, sure, 1.0 - sure)).sum(1)


def mixed(two: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of nodes with longer contexts below, and the share of their own estimate."""
    log = log_kt(two)
    return np.logaddexp(log, below) - math.log(2), sigmoid(log - below)


def above(rows: DataFrame) -> DataFrame:
    """(name, n0, n1, below), a row for each node -> (name, n0, n1, log, weight, one)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], 1)
            log, weight = mixed(two, batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(log), pa.array(weight), pa.array(kt_one(two))], ["name", "n0", "n1", "log", "weight", "one"])

    return rows.mapInArrow(run, "name long, n0 double, n1 double, log double, weight double, one double")


def shorter(d: int) -> Column:
    """A node's name -> the name of the node above it, whose context has d bytes."""
    return F.shiftleft(F.shiftright("name", 8).bitwiseAND(F.lit((1 << 8 * d) - 1)), 8).bitwiseOR(F.col("name").bitwiseAND(F.lit(255)))


def whole(grams: DataFrame) -> DataFrame:
    """(gram, n, m), a row for each gram of any text, n 0 where it was not learnt -> (gram, m, p), p log10 of its last byte.

    A node has at most 256 nodes right below it, so no join and no sum has a hot key. Grams that share the last HEAD bytes of their context
    are in one task, as are the nodes that these contexts have.
    """
    tasks = max(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // TASK_GRAMS))
    kinds = {"name": "long", "n": "long", "m": "long", "sure": "double", "left": "double"}
    of = lambda **own: [own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    head = F.shiftright("name", 8).bitwiseAND(F.lit((1 << 8 * HEAD) - 1))
    rows = grams.select(*of(name=F.col("gram"), n=F.col("n"), m=F.col("m")))

    def gathered(batches: Iterable[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
        """A task's grams and the nodes they hang from."""
        own = [b for b in batches if b.num_rows]
        if not own:
            return (empty := pa.table({c: pa.array([], pa.int64()) for c in kinds})), empty
        every = pa.Table.from_batches(own)
        return every.filter(pa.compute.is_valid(every["n"])), every.filter(pa.compute.is_null(every["n"]))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = gathered(batches)
        if own.num_rows:
            branch = Branch(own["name"].to_numpy(), own["n"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(branch.names), pa.array(branch.two[:, 0]), pa.array(branch.two[:, 1]), pa.array(branch.log)], ["name", "n0", "n1", "log"])

    level = keep(rows.repartition(tasks, head).mapInArrow(first, "name long, n0 double, n1 double, log double"), "lm-heads")
    levels = {HEAD: level}
    for d in range(HEAD - 1, -1, -1):
        level = keep(above(level.groupBy(shorter(d).alias("name")).agg(*(F.sum(c).alias(c) for c in ("n0", "n1")), F.sum("log").alias("below"))), "lm-nodes")
        levels[d] = level
    sure, left = F.col("sure"), F.col("left")
    top = levels[0].select("name", (F.col("weight") * F.col("one")).alias("sure"), (1 - F.col("weight")).alias("left"))
    for d in range(1, HEAD):
        up = top.select(F.col("name").alias("up"), "sure", "left")
        own = levels[d].withColumn("up", shorter(d - 1)).join(up, "up")
        top = own.select("name", (sure + left * F.col("weight") * F.col("one")).alias("sure"), (left * (1 - F.col("weight"))).alias("left"))
    heads = levels[HEAD].select("name", shorter(HEAD - 1).alias("up")).join(top.select(F.col("name").alias("up"), "sure", "left"), "up")

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nodes = gathered(batches)
        if own.num_rows:
            branch = Branch(own["name"].to_numpy(), own["n"].to_numpy())
            order = np.argsort(nodes["name"].to_numpy())  # the same nodes as the branch's, which are sorted
            assert np.array_equal(nodes["name"].to_numpy()[order], branch.names)
            p = branch.log10(nodes["sure"].to_numpy()[order], nodes["left"].to_numpy()[order])
            yield pa.RecordBatch.from_arrays([own["name"].combine_chunks(), own["m"].combine_chunks(), pa.array(p)], ["gram", "m", "p"])

    both = rows.unionByName(heads.select(*of(name=F.col("name"), sure=sure, left=left)))
    return keep(both.repartition(tasks, head).mapInArrow(second, "gram long, m long, p double"), "lm-model")


def frequent(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The grams that at most `most` reach, by eighths of powers of two of their frequency, sorted, and their p; and the least such step listed."""
    step = F.floor(F.log2("m") * 8)
    n, least = 0, None
    for r in sorted(model.groupBy(step.alias("step")).count().collect(), reverse=True):
        n += r["count"]
        if n > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0), 2**62
    got = model.filter(step >= least).select("gram", "p").toArrow()
    names, p = got["gram"].to_numpy(), got["p"].to_numpy()
    order = np.argsort(names)
    return names[order], p[order], least


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each behind DEPTH bytes 255 and before one, and the places of all coded bytes: those of texts and end bytes."""
    data = np.frombuffer(_PAD + (b"\xff" + _PAD).join(texts) + b"\xff", np.uint8).astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(size + DEPTH) - size
    at = np.arange(size.sum())
    return data, at + np.repeat(starts - (np.cumsum(size) - size), size)


def before(data: np.ndarray) -> np.ndarray:
    """At each place from DEPTH on, the DEPTH bytes before it as a number."""
    out = np.zeros(len(data) - DEPTH, np.int64)
    for j in range(DEPTH):
        out = out << 8 | data[j : j + len(out)]
    return out


def code_lengths(texts: list[bytes], names: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log10 of each text's probability: each byte by the longest context in the tree."""
    data, at = stream(texts)
    which, ctx = pd.factorize(before(data)[at - DEPTH])
    row = np.full(len(ctx), len(names), np.int64)
    for d in range(1, DEPTH + 1) if len(names) else ():
        name = d << 48 | ctx & (1 << 8 * d) - 1
        found = np.minimum(np.searchsorted(names, name), len(names) - 1)
        row = np.where(names[found] == name, found, row)
    p = table.ravel()[row[which] * 256 + data[at]].astype(np.float64)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.add.reduceat(p, np.cumsum(size) - size)


def listed_lengths(texts: list[bytes], names: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """log10 of each text's probability as far as its grams are listed, and the others with their counts."""
    data, at = stream(texts)
    which, grams = pd.factorize(before(data)[at - DEPTH] << 8 | data[at])
    found = np.minimum(np.searchsorted(names, grams), len(names) - 1)
    known = names[found] == grams if len(names) else np.zeros(len(grams), bool)
    own = np.where(known, p[found], 0.0) if len(names) else np.zeros(len(grams))
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    places = np.flatnonzero(~known[which])
    pairs, n = np.unique(np.repeat(np.arange(len(texts)), size)[places] * len(grams) + which[places], return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(grams)).astype(np.int32)
    rest = pa.StructArray.from_arrays([pa.array(grams[pairs % max(1, len(grams))]), pa.array(n.astype(np.int64))], ["gram", "tf"])
    return np.add.reduceat(own[which], np.cumsum(size) - size), pa.ListArray.from_arrays(pa.array(ends), rest)


def counts(docs: DataFrame, held: str | None = None) -> DataFrame:
    """docs (text) -> word (binary) or gram (DEPTH + 1 bytes as a number), n: summed; m: likewise, but over all texts. The end of a text is
    the empty word. Texts where the column `held` is true are not learnt from: their words are left out, their grams have n 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: dict[bool, list[pd.Series]] = {False: [], True: []}

        def told(words: list | None, grams: np.ndarray | None, n, held: bool = False) -> pa.RecordBatch:
            null = lambda kind: pa.nulls(len(n), kind)
            m = pa.array(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()) if words is not None else null(pa.binary()), pa.array(grams) if grams is not None else null(pa.int64()), pa.array(np.zeros(len(n), np.int64)) if held else m, m], ["word", "gram", "n", "m"])

        def merged(own: list[pd.Series]) -> pd.Series:
            return pd.concat(own).groupby(level=0, sort=False).sum() if len(own) > 1 else own[0]

        for batch in slices(batches, 0):
            both = [(x or "").encode() for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for held, own in grams.items():
                texts = [t for t, h in zip(*both, strict=True) if h == held]
                if not texts:
                    continue
                if not held:
                    for t in texts:
                        words.update(t.translate(_LOWER).split())
                    words[b""] += len(texts)
                data, at = stream(texts)
                own.append(pd.Series((before(data)[at - DEPTH] << 8) | data[at]).value_counts(sort=False))
                if sum(map(len, own)) > 3_000_000:
                    own[:] = [merged(own)]
                    if len(own[0]) > 1_500_000:
                        yield told(None, own[0].index.to_numpy(np.int64), own[0].to_numpy(np.int64), held)
                        own.clear()
            if len(words) > 400_000:
                yield told(list(words), None, list(words.values()))
                words.clear()
        if words:
            yield told(list(words), None, list(words.values()))
        for held, own in grams.items():
            if own:
                last = merged(own)
                yield told(None, last.index.to_numpy(np.int64), last.to_numpy(np.int64), held)

    source = docs.select(F.col("text").cast("string").alias("text"), (F.col(held) if held else F.lit(False)).alias("held"))
    return source.mapInArrow(run, "word binary, gram long, n long, m long").groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def held_out(key: Column) -> Column:
    """Whether the text is not learnt from: CRC-32 of its id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", contexts: int | None = None) -> DataFrame:
    """docs -> key, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte; a row for each row of docs.

    score is log10 of the text's probability by context-tree weighting, base_score that by counts of words (A to Z in lower case) with one
    added. Null texts are empty: one end token, one end byte. Without a training text every bit has probability 1/2. contexts: a number
    prunes the tree to its most frequent contexts; None keeps it whole.

    Frequent words and grams are scored in the pass over the texts; the rest, one row for each text and word or gram, is joined to the counts
    and the model. What is joined is less frequent than all that is listed, so no key is hot.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[key]
    source = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    found = keep(counts(source, "held_out"), "lm-counts")
    of_words = found.filter("word IS NOT NULL").select(F.col("word").alias("key"), "n")
    total, distinct = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = found.filter("gram IS NOT NULL")
    if contexts is None:
        every = whole(grams.select("gram", "n", "m"))
        *model, least = frequent(every, GRAMS)
    else:
        model = train(grams.filter("n > 0").select("gram", "n"), contexts)
    top = of_words.filter(F.octet_length("key") <= LONGEST).orderBy(F.col("n").desc(), "key").limit(LISTED).select("key", "n").toPandas()
    listed = dict(zip(map(bytes, top["key"]), top["n"].tolist(), strict=True))
    shared = spark.sparkContext.broadcast((listed, *model))
    pairs_of = pa.list_(pa.struct([("gram", pa.int64()), ("tf", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, *model = shared.value
        for batch in slices(batches, 3, 2_000_000):
            texts = [(x or "").encode() for x in batch.column(3).to_pylist()]
            tokens, known, base, rest, offsets = [], [], [], [], [0]
            for t in texts:
                own = Counter(t.translate(_LOWER).split())
                own[b""] += 1
                n_known, logs = 0, 0.0
                for w, n in own.items():
                    c = listed.get(w)
                    if c is None:
                        rest.append((w, n))
                    else:
                        n_known += n
                        logs += n * math.log10(c + 1)
                tokens.append(own.total()), known.append(n_known), base.append(logs), offsets.append(len(rest))
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            scores, rare = listed_lengths(texts, *model) if contexts is None else (code_lengths(texts, *model), pa.nulls(len(texts), pairs_of))
            pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in rest], pa.binary()), pa.array([n for _, n in rest], pa.int64())], ["key", "tf"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs), rare], ["id", "row", "held_out", "n_tokens", "known", "logs", "score", "bytes", "rest", "rare"])

    rows = keep(source.mapInArrow(run, f"id {kind}, row long, held_out boolean, n_tokens long, known long, logs double, score double, bytes long, rest array<struct<key:binary,tf:long>>, rare array<struct<gram:long,tf:long>>"), "lm-rows")
    last = int(top["n"].iloc[-1]) if len(top) == LISTED else 2**62
    rare = of_words.filter((F.col("n") <= last) | (F.octet_length("key") > LONGEST)).select("key", "n")
    joined = rows.select("row", F.explode("rest").alias("x")).select("row", "x.key", "x.tf").join(rare, "key")
    more = joined.groupBy("row").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more_logs"))
    out = rows.drop("rest", "rare").join(more, "row", "left")
    if contexts is None:
        unlisted = every.filter(F.floor(F.log2("m") * 8) < least).select("gram", "p")
        joined = rows.select("row", F.explode("rare").alias("x")).select("row", "x.gram", "x.tf").join(unlisted, "gram")
        out = out.join(joined.groupBy("row").agg(F.sum(F.col("tf") * F.col("p")).alias("more_score")), "row", "left")
        out = out.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    n_known = F.col("known") + F.coalesce("more_known", F.lit(0))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    per_byte = -F.col("score") * math.log2(10) / (F.col("bytes") + 1)
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(total)).alias("train_tokens"), base.alias("base_score"), "score", "bytes", per_byte.alias("bits_per_byte"))
