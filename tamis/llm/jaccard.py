"""N-gram Jaccard join in the metric space of shingle sets: pivots, Voronoi regions, windows of the triangle inequality, recursion, exact links.

1. Equal sets become one node.
2. Unlike texts all lie near distance 1 from any pivot, where the triangle inequality leaves nothing out: pivots alone would replicate every
   set into every region. So sets are first dealt by projections. A fixed partition splits all shingles into classes; the distance |x - y|
   + |y - x| of two sets is the sum of the distances of their parts in each class, and the threshold bounds it. With more classes than that
   bound, two linked sets have an equal part (distance 0) in one class at least, so they meet in the region of that part. Sizes are dealt in
   bands, with a window that replicates a set into the band below, if a partner may lie there.
   In fact they meet in several, as more classes are shown than that: so a set drops its weakest regions, up to half of what a partner shares.
3. Regions that still share a set are one family. A family is joined in the metric space: it takes several pivots, those that meet most others in
   the regions first. Distances of all members from them are exact, and give the links of the pivots, which leave. A member goes to the
   region of its nearest pivot and, by the triangle inequality, into each other one whose pivot is farther than its nearest one by no more than
   twice the threshold. Inside the threshold's ball of a pivot all are linked; of these only the border stays that may reach a member outside.
   Each such region is joined again in the same way. A region that its pivots do not separate (one of the new ones would hold most of it, or
   all together twice as many) is cut into blocks, and each two blocks are compared. So regions shrink by a quarter at each level.
4. Regions of at most LEAF sets, and pairs of blocks, are one task's: pivots, Voronoi regions and windows go on inside it by the same rules, and what
   they do not separate is compared exactly, all at once. A family of up to a pivot more than PIVOTS is done with its pivots. Links make components.

No region is gathered into one task: members are rows, hot regions are counted by partial sums and split by Spark's joins. What is exact is so
on 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.llm.common import bitmap, free, keep, ship, slices
from tamis.llm.graph import components

#: So many sets are compared in one task; so many pivots a larger region has.
LEAF, PIVOTS = 256, 4
#: The least sizes of two bands are as 2 to 3.
BAND = 1.5
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over all 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(29))) * _TWO
    return (h ^ (h >> np.uint64(32))) * _ONE


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, sorted."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - k + 1)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.full(n, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        h = mixed((h ^ own[i : i + n]) * _ONE)
    return np.unique(h.view(np.int64))


def reach(n: int, num: int, den: int) -> int:
    """How far a partner of similarity num / den or more can be from a set of n, where n is the smaller one of both."""
    return n * (den - num) // num


@lru_cache(maxsize=4096)
def band(n: int) -> tuple[int, int]:
    """The band [lo, hi) of sizes that n lies in."""
    lo = 1
    while (hi := max(lo + 1, int(lo * BAND))) <= n:
        lo = hi
    return lo, hi


@lru_cache(maxsize=4096)
def partition(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """For a band: the number of classes, and how many more a set shows than could differ from a partner: a quarter more, or what leaves parts that
    are not empty, if that is more."""
    need = reach(hi - 1, num, den) + 1
    spare = 1 + need // 4
    while True:
        p = need + spare
        a = lo / p
        empty = p * math.exp(-a)
        off = math.sqrt(max(0.0, p * (math.exp(-a) - (1 + a) * math.exp(-2 * a))))
        if spare >= empty + 4 * off + 1 or spare > 64 * need + 64:
            return p, spare
        spare += 1 + spare // 8


def signatures(s: np.ndarray, num: int, den: int) -> tuple[list[np.ndarray], list[int]]:
    """The regions of a set of shingles: for its band, and the band of its smallest partner where that is another one, hashes of its parts, and how
    many of these it shares at least with any partner there."""
    n, out, least = len(s), [], []
    if not n:
        return out, least
    h = s.view(np.uint64)
    for lo, hi in sorted({band(m) for m in (n, (n * num + den - 1) // den)}):
        far = reach(n, num, den) if lo <= n < hi else 2 * n * (den - num) // (den + num)
        if reach(hi - 1, num, den) == 0 or far == 0:
            continue  # its partners here are equal sets
        p, spare = partition(lo, hi, num, den)
        shown = min(p, far + 1 + spare)
        at = ((h >> np.uint64(20)) % np.uint64(p)).astype(np.int64)
        inside = np.flatnonzero(at < shown)
        at = at[inside]
        order = np.argsort(at, kind="stable")
        at, part = at[order], mixed(h[inside[order]])
        start = np.flatnonzero(np.concatenate([at[:1] >= 0, at[1:] != at[:-1]]))
        sums, places = (np.add.reduceat(part, start), at[start]) if len(start) else (part, at)
        own = mixed(sums ^ mixed(np.uint64(lo << 32) + places.astype(np.uint64))).view(np.int64)
        empty = shown - len(places)
        if empty > spare:  # too many to be sure of a part that is not: these are shown too
            rest = np.setdiff1d(np.arange(shown), places, assume_unique=True)
            own = np.concatenate([own, mixed(mixed(np.uint64(lo << 32) + rest.astype(np.uint64))).view(np.int64)])
        out.append(own), least.append(max(1, 1 + spare - empty))
    return out, least


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, any others) -> with common, either: the sizes of intersection and union."""
    one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(two, "b").join(one, "a").select(*pairs.columns, common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either"))


def forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Of the links between sets, by all pairs, enough to connect what they connect."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)[times[column] > 1]
    _, column = np.unique(column[times[column] > 1], return_inverse=True)
    common, order = np.zeros((n, n), np.float64), np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((n, 4096), np.float32)
        part[row[i:j], column[i:j] - start] = 1.0
        common += part @ part.T
    up, out = list(range(n)), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in np.argwhere(np.triu(den * common >= num * (size[:, None] + size - common), 1)).tolist():
        if (p := top(i)) != (q := top(j)):
            up[q] = p
            out.append((i, j))
    return out


def joined(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int, bool]]:
    """Of the links between the sets of a task enough to connect what they connect, and whether a pivot found each: pivots, Voronoi regions and windows as between
    tasks, and all pairs of what pivots do not separate."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.concatenate([[0], size.cumsum()])
    columns = [column[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    held, r, out, todo = np.zeros(len(column), bool), (den - num) / den + 1e-9, [], [np.arange(n)]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        flat, starts = np.concatenate([columns[i] for i in own]), np.concatenate([[0], size[own][:-1].cumsum()])
        chosen = np.unique(np.linspace(0, len(own) - 1, min(PIVOTS, len(own))).astype(int))
        far, linked = np.zeros((len(chosen), len(own))), np.zeros((len(chosen), len(own)), bool)
        for k, i in enumerate(chosen):
            held[columns[own[i]]] = True
            common = np.add.reduceat(held[flat].astype(np.int64), starts)
            held[columns[own[i]]] = False
            either = size[own[i]] + size[own] - common
            far[k], linked[k] = 1 - common / either, den * common >= num * either
            out += [(int(own[i]), int(own[j]), True) for j in np.flatnonzero(linked[k]) if j != i]
        # pivots have met all members and leave
        rest = np.setdiff1d(np.arange(len(own)), chosen, assume_unique=True)
        if len(rest) < 2:
            continue
        far, linked, ids = far[:, rest], linked[:, rest], own[rest]
        dealt = far <= far.min(0) + 2 * r
        inner = np.where(dealt & ~linked, far, np.inf).min(1, keepdims=True)
        stays = dealt & (~linked | (far >= inner - r))
        if dealt.sum(1).max() <= 0.75 * len(own) and dealt.sum() <= 2 * len(own):
            todo += [ids[stays[k]] for k in range(len(chosen))]
        elif len(whole := ids[(stays | ~dealt).all(0)]) > 1:
            out += [(int(whole[i]), int(whole[j]), False) for i, j in forest([sets[i] for i in whole], num, den)]
    return out


def compared(tasks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """tasks (task, id), up to LEAF sets a task or little more -> links (a, b, pivot) between the sets of a task, enough to connect them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, task = [], [], None

        def told() -> pa.RecordBatch:
            found = joined(own, num, den) if len(own) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, *_ in found], pa.int64()), pa.array([ids[j] for _, j, _ in found], pa.int64()), pa.array([p for *_, p in found], pa.bool_())], ["a", "b", "pivot"])

        for batch in batches:
            for t, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if t != task:
                    yield told()
                    ids, own, task = [], [], t
                ids.append(i), own.append(s.values.to_numpy())
        yield told()

    rows = tasks.join(sets, "id").select("task", "id", "s").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(run, "a long, b long, pivot boolean")


def links(members: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """members (region, id, n, c: how often it meets others), sets (id, s) -> links (a, b) found by pivots, and those of all pairs of what pivots do not
    separate: enough
    of both to connect whatever the threshold connects."""
    tasks, by_pivots = [], []
    r = F.lit((den - num) / den)
    members = keep(members.join(members.groupBy("region").agg(F.count("*").alias("m")).filter("m > 1"), "region"), "jaccard-members")
    while True:
        tasks.append(members.filter(F.col("m") <= LEAF).select(F.col("region").alias("task"), "id"))
        big = members.filter(F.col("m") > LEAF)
        if big.isEmpty():
            break
        pick = F.max(F.struct("c", F.xxhash64("id").alias("h"), "id"))
        pivots = big.groupBy("region", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("k")).agg(pick.alias("p")).groupBy("region").agg(F.collect_list("p.id").alias("pivots"))
        met = keep(big.join(pivots, "region").select("region", "id", "n", "c", "m", "pivots"), "jaccard-met")
        pairs = met.select(F.explode("pivots").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
        far = verified(pairs, sets).select("a", "b", (den * F.col("common") >= num * F.col("either")).alias("linked"), (1 - F.col("common") / F.col("either")).alias("d"))
        far = keep(far, "jaccard-far")
        by_pivots.append(far.filter("linked").select("a", "b"))
        # pivots have met all members of their regions and leave them
        near = met.filter(~F.array_contains("pivots", F.col("id"))).withColumn("a", F.explode("pivots")).join(far.withColumnRenamed("b", "id"), ["a", "id"])
        near = near.groupBy("region", "id").agg(*(F.first(c).alias(c) for c in ("n", "c", "m")), F.collect_list(F.struct("d", F.col("a").alias("pivot"), "linked")).alias("all"))
        near = near.withColumn("all", F.filter("all", lambda p: p["d"] <= F.array_min(F.transform("all", lambda q: q["d"])) + 2 * r + 1e-9))
        dealt = keep(near.select("region", "id", "n", "c", "m", F.explode("all").alias("p")).select("region", "id", "n", "c", "m", "p.*"), "jaccard-dealt")
        cell = dealt.groupBy("region", "pivot").agg(F.first("m").alias("m"), F.count("*").alias("own"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("inner"))
        apart = cell.groupBy("region").agg(((F.max("own") <= 0.75 * F.first("m")) & (F.sum("own") <= 2 * F.first("m"))).alias("apart"))
        # a member stays where a pivot does not show that all its links are inside the pivot's ball
        stays = F.coalesce(~F.col("linked") | (F.col("d") >= F.col("inner") - r - 1e-9), F.lit(False))
        windows = dealt.drop("m").join(cell.join(apart, "region"), ["region", "pivot"]).withColumn("stays", stays)
        new = windows.filter("apart AND stays").select(F.xxhash64("region", "pivot").alias("region"), "id", "n", "c")
        whole = windows.filter("NOT apart").groupBy("region", "id").agg(F.bool_and("stays").alias("stays")).filter("stays")
        whole = keep(whole.join(whole.groupBy("region").agg(F.ceil(F.count("*") / max(1, LEAF // 2)).alias("blocks")), "region"), "jaccard-whole")
        own = F.pmod(F.xxhash64("id"), F.col("blocks"))
        blocks = whole.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        tasks.append(blocks.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "id"))
        new = keep(new.join(new.groupBy("region").agg(F.count("*").alias("m")).filter("m > 1"), "region"), "jaccard-members")
        free(met, dealt)
        members = new
    union = lambda frames: reduce(DataFrame.union, frames)
    exact = keep(compared(union(tasks), sets, num, den), "jaccard-links")
    by_pivots.append(exact.filter("pivot").select("a", "b"))
    return union(by_pivots), exact.filter("NOT pivot").select("a", "b")


class Chosen:
    """Rows by a bitmap of a fixed size over the hashes of their texts, broadcast; joins behind it take out those let through by chance."""

    def __init__(self, chosen: DataFrame, bits: int = 24):
        self.shift = np.uint64(64 - bits)
        self.shared = chosen.sparkSession.sparkContext.broadcast(bitmap(chosen.select("h"), bits))

    def of(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) >> self.shift
            hit = (self.shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))


def families(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, keys, least) -> members (region, id, n, c): the nodes that may have a partner, by family, and in how many places they meet others.

    A region is named by its least node. Two partners x, y share as many regions as either's `least`; x drops names of under half of its own in
    sum, y likewise, so one shared region is left to both.
    """
    bands = nodes.select(F.col("node").alias("id"), "n", F.posexplode(F.arrays_zip("keys", "least")).alias("band", "b")).select("id", "n", "band", F.col("b.least").alias("least"), F.col("b.keys").alias("keys"))
    each = bands.select("id", "band", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lo")).filter("m > 1")
    met = each.join(shared, "key").groupBy("id", "band", "lo").agg(F.count("*").alias("w"), F.sum("m").alias("c")).join(bands.drop("keys"), ["id", "band"])
    by = W.partitionBy("id", "band")
    met = met.withColumn("total", F.sum("w").over(by)).withColumn("weaker", F.sum("w").over(by.orderBy("w", "lo").rowsBetween(W.unboundedPreceding, 0)))
    met = keep(met.filter("total >= least AND 2 * weaker >= least").select("id", "n", "lo", "c"), "jaccard-met")
    # a name links the sets that kept it, whether or not the least node itself did
    alone = met.groupBy("lo").agg(F.countDistinct("id").alias("k")).filter("k > 1").select("lo")
    met2 = met.join(alone, "lo")
    own = components(met2.select(F.col("id").alias("a"), F.col("lo").alias("b"))).withColumnRenamed("component", "region")
    out = keep(met2.groupBy("id").agg(F.first("n").alias("n"), F.sum("c").alias("c")).join(own, "id").select("region", "id", "n", "c"), "jaccard-families")
    free(met)
    return out


def classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> key, n_shingles, component_id (the least key reachable by links of similarity num / den or more, itself included), a row for
    each row of docs.

    Words are runs of anything but ASCII white space, A to Z in lower case. A set holds the distinct shingles of k words; fewer words are one
    shingle; null and empty texts have none and link with nothing. Rows that share a key are one node, linked by the texts of all of them. A
    null key is no node and its class is null. Keys have to be integers.
    """
    return classed(docs, k, num, den, key, text)[0]


def classed(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """classes(), and the links between nodes that pivots found and those of what they did not separate."""
    spark = docs.sparkSession
    ship(spark)
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text_of).alias("h"), text_of.alias("text"))
    node = lambda s: xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)

    def first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            own = [shingles(t, k) for t in batch.column(2).to_pylist()]
            n = pa.array(np.fromiter(map(len, own), np.int64, len(own)))
            nodes = pa.array([node(s) if len(s) else None for s in own], pa.int64())
            shown = [signatures(s, num, den) for s in own]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(least) for _, least in shown])]).astype(np.int32))
            keys = pa.ListArray.from_arrays(ends, _lists([x for keys, _ in shown for x in keys]))
            least = pa.ListArray.from_arrays(ends, pa.array([x for _, least in shown for x in least], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, nodes, keys, least], ["id", "h", "n", "node", "keys", "least"])

    def whole(batches: Iterable[pa.RecordBatch], rows: Chosen) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows.of(batches), 2):
            own = [shingles(t, k) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([node(s) if len(s) else None for s in own], pa.int64()), _lists(own)], ["id", "h", "node", "s"])

    read = keep(source.mapInArrow(first_pass, "id long, h long, n long, node long, keys array<array<long>>, least array<int>"), "jaccard-read")
    real = read.filter("node IS NOT NULL AND id IS NOT NULL")
    nodes = keep(real.groupBy("node").agg(F.min(F.struct("id", "h")).alias("r"), F.min("n").alias("n"), F.first(F.struct("keys", "least")).alias("shown")).select("node", F.col("r.id").alias("rep"), F.col("r.h").alias("h"), "n", "shown.*"), "jaccard-nodes")
    rows = keep(read.select("id", "n", "node"), "jaccard-rows")
    free(read)
    members = families(nodes)
    reps = keep(nodes.select("node", "rep", "h"), "jaccard-reps")
    free(nodes)
    chosen = keep(reps.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "jaccard-chosen")
    pick = Chosen(chosen)
    named = chosen.select("node", "rep", F.col("h").alias("first"))
    sets = source.mapInArrow(lambda b: whole(b, pick), "id long, h long, node long, s array<long>").join(named, "node").filter("id = rep AND h = first")
    sets = keep(sets.dropDuplicates(["node"]).select(F.col("node").alias("id"), "s"), "jaccard-whole")  # by node, as joined
    by_pivots, by_leaves = links(members, sets, num, den)
    name = lambda c: reps.select(F.col("node").alias(c), F.col("rep").alias(f"rep_{c}"))
    linked = by_pivots.union(by_leaves).join(name("a"), "a").join(name("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # a key with several texts links them
    several = rows.filter("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("p"), F.max("node").alias("q")).filter("p <> q").select("id")
    several = rows.join(several, "id", "left_semi").join(reps, "node").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    class_of = components(linked.union(several)).withColumnRenamed("id", "rep")
    named = reps.join(class_of, "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, "node", "left")
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out, by_pivots, by_leaves
