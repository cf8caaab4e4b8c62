"""Conversation structure repair by a backward cost-to-go programme over turns and grammar states.

A repaired conversation is empty or an optional system turn and then user and assistant turns in pairs. The cost of what is still to do depends on
the row and on the last role only, so a row is a small function from costs behind it to costs before it, and a stretch of rows is a 4 x 4 matrix
of least sums. Conversations are cut into stretches; matrices of a conversation's stretches give the cost-to-go at every border, the greedy walk
inside each stretch is made for all four states that it may begin in, and the states at the borders are then followed from the first stretch on.
So a conversation of any length is spread over tasks. Rows are judged and walked without their texts; the texts move once, to meet their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import keep, ship

#: Places of a stretch.
STRETCH = 1 << 14
#: Costs: an insertion or a new role, a deletion, a truncated row that stays.
INSERT, DELETE, TRUNCATED = 3, 4, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
#: States: before all turns, behind a system, a user, an assistant turn. The state that an inserted or renamed turn leads to, the state that a kept
#: system, user, assistant or other turn leads to (4: none), the costs to go behind the last row, and how many turns to insert there.
NEXT = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
LAST, TAIL = np.array([0, 6, 3, 0]), np.array([0, 2, 1, 0])
FAR = 1 << 40
ROLES = ("user", "assistant")
#: How many first characters of a text order rows that share conversation, turn and role; the rest goes by MD5.
HEAD = 24


def damage(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its .!? away,
    3 repeats it, 4 makes it a user's. Nulls in role, text and key are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("kind", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind")


def _back(cost: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Costs to go behind a row, (rows, any, 4) -> before it, insertions included."""
    fault = code & 3
    padded = np.concatenate([cost, np.full((*cost.shape[:-1], 1), FAR)], -1)
    kept = np.take_along_axis(padded, np.broadcast_to(KEPT[code >> 2][:, None, :], cost.shape), -1)
    stay = np.minimum(kept, cost[..., NEXT] + INSERT) + TRUNCATED * (fault == CUT)[:, None, None]
    stay[(fault == BLANK) | (fault == DUPLICATE)] = FAR
    best = np.minimum(cost + DELETE, stay)
    return np.minimum(np.minimum(best, best[..., NEXT] + INSERT), best[..., NEXT[NEXT]] + 2 * INSERT)


def _groups(lists: pa.ListArray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches by falling length, in groups of at most `most` padded places -> their numbers, lengths and codes, aligned at the end."""
    length, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    begin, order, at = length.cumsum() - length, np.argsort(-length, kind="stable"), 0
    while at < len(order):
        widest = int(length[order[at]])
        own = order[at : at + max(1, most // widest)]
        codes, n = np.zeros((len(own), widest), np.int64), length[own]
        inside = np.arange(widest) >= widest - n[:, None]
        codes[inside] = flat[np.concatenate([np.arange(begin[i], begin[i] + length[i]) for i in own])]
        yield own, n, codes
        at += len(own)


def matrix(n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(stretches, state behind, state before): the least cost of the stretch between the two."""
    cost = np.repeat(np.where(np.eye(4, dtype=bool), 0, FAR)[None], len(n), 0)
    for j in range(codes.shape[1]):
        k = int((n > j).sum())
        cost[:k] = np.minimum(_back(cost[:k], codes[:k, -1 - j]), FAR)
    return cost


def walk(n: np.ndarray, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ASCII-least cheapest edits of stretches from each state, given the costs to go behind them (stretches, 4) -> states behind (stretches, 4) and
    edits (stretches, places, 4): three times the insertions before a row, and 0, 1 or 2 for its deletion, keeping or new role."""
    width = codes.shape[1]
    togo = [end]
    for j in range(width):
        k = int((n > j).sum())
        cost = togo[-1].copy()
        cost[:k] = _back(cost[:k, None], codes[:k, -1 - j])[:, 0]
        togo.append(cost)
    state, edits = np.repeat(np.arange(4)[None], len(n), 0), np.zeros((len(n), width, 4), np.uint8)
    for left in range(width, 0, -1):
        k = int((n >= left).sum())
        st, now, then, code = state[:k], togo[left][:k], np.concatenate([togo[left - 1][:k], np.full((k, 1), FAR)], 1), codes[:k, width - left]
        at = lambda cost, s: np.take_along_axis(cost, s, 1)
        inserted = np.zeros_like(st)
        for _ in range(2):
            go = (at(now, st) != DELETE + at(then, st)) & (at(now, st) == INSERT + at(now, NEXT[st]))
            st, inserted = np.where(go, NEXT[st], st), inserted + go
        fault, kept = (code & 3)[:, None], KEPT[(code >> 2)[:, None], st]
        drop = at(now, st) == DELETE + at(then, st)
        same = ~drop & (fault != BLANK) & (fault != DUPLICATE) & (at(now, st) == TRUNCATED * (fault == CUT) + at(then, kept))
        edits[:k, width - left] = 3 * inserted + np.where(drop, 0, np.where(same, 1, 2))
        state[:k] = np.where(drop, st, np.where(same, kept, NEXT[st]))
    return state, edits


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((batch.num_rows, 16), np.int64)
        for own, n, codes in _groups(batch.column(2)):
            out[own] = matrix(n, codes).reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out, pa.int64())], ["c", "p", "m"])


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's stretches in order the costs to go behind them."""
    for batch in batches:
        count = batch.column(0).value_lengths().to_numpy()
        p, m = (x for x in batch.column(0).flatten().flatten())
        m, out = m.flatten().to_numpy().reshape(-1, 4, 4), np.repeat(LAST[None], len(p), 0)
        first = count.cumsum() - count
        for i in np.flatnonzero(count > 1):
            for j in range(first[i] + count[i] - 2, first[i] - 1, -1):
                out[j] = (m[j + 1] + out[j + 1][:, None]).min(0)
        yield pa.RecordBatch.from_arrays([p, _lists(out, pa.int64())], ["p", "end"])


def _walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        end, out, texts = batch.column(4).flatten().to_numpy().reshape(-1, 4), np.zeros((batch.num_rows, 4), np.int64), [b""] * batch.num_rows
        for own, n, codes in _groups(batch.column(3)):
            out[own], edits = walk(n, codes, end[own])
            for i, k, e in zip(own, n, edits, strict=True):
                texts[i] = e[len(e) - k :].T.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists(out, pa.int64()), pa.array(texts, pa.binary())], ["c", "p", "ats", "codes", "exits", "edits"])


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's stretches in order the state they begin in, and of the last one how many turns to insert behind it."""
    for batch in batches:
        count = batch.column(0).value_lengths().to_numpy()
        p, exits = batch.column(0).flatten().flatten()
        exits, entry, tail = exits.flatten().to_numpy().reshape(-1, 4), np.zeros(len(p), np.int32), np.zeros(len(p), np.int32)
        last = count.cumsum() - 1
        for i in np.flatnonzero(count > 1):
            for j in range(last[i] - count[i] + 1, last[i]):
                entry[j + 1] = exits[j, entry[j]]
        tail[last] = TAIL[exits[last, entry[last]]]
        yield pa.RecordBatch.from_arrays([p, pa.array(entry), pa.array(tail)], ["p", "entry", "tail"])


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column(0).value_lengths().to_numpy()
        entry, tail = (batch.column(i).to_numpy() for i in (3, 4))
        edits = [np.frombuffer(e, np.uint8).reshape(4, -1)[s] for e, s in zip(batch.column(2).to_pylist(), entry, strict=True)]
        behind = np.zeros(int(n.sum()), np.int32)
        behind[n.cumsum() - 1] = tail
        yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), batch.column(1).flatten(), pa.array(np.concatenate([np.empty(0, np.int32), *edits]), pa.int32()), pa.array(behind)], ["at", "code", "edit", "tail"])


KEY = ["c", "turn", "role", "head", "h"]


def _keyed(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(x), F.lit(" ")) for x in ("role", "text"))
    return turns.select(F.struct("conv_id").alias("c"), "turn", role.alias("role"), F.left(text, F.lit(HEAD)).alias("head"), F.unhex(F.md5(text.cast("binary"))).alias("h"), text.alias("text"))


def _code(role: Column, text: Column) -> Column:
    """4 * the role's class by its first character, + its fault, repeats aside."""
    first = F.left(role, F.lit(1))
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    return 4 * kind + fault


def edits(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> a row per turn: c (its conv_id in a struct), turn, role, head, h, at, code, edit, tail."""
    ship(turns.sparkSession)
    rows = _keyed(turns).select(*KEY, _code(F.col("role"), F.col("text")).alias("code"))
    rows = keep(rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id()), "repair-rows")
    firsts = rows.groupBy("c", "role", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("first").isNull() & (F.col("code").bitwiseAND(3) != BLANK), F.col("code") - F.col("code").bitwiseAND(3) + DUPLICATE).otherwise(F.col("code"))
    judged = rows.select("c", "at", "code").join(firsts, "at", "left").select("c", "at", fault.alias("code"))
    pieces = judged.groupBy("c", F.floor(F.col("at") / STRETCH).alias("s")).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("x"))
    pieces = keep(pieces.select("c", F.get("x", F.lit(0))["at"].alias("p"), F.col("x.at").alias("ats"), F.col("x.code").alias("codes")), "repair-pieces")
    c = "c struct<conv_id:{}>".format(dict(turns.dtypes)["conv_id"])
    in_order = lambda df, x: df.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("p", x))).alias("x")).select("x")
    matrices = pieces.select("c", "p", "codes").mapInArrow(_matrices, f"{c}, p long, m array<long>")
    ends = in_order(matrices, "m").mapInArrow(_ends, "p long, end array<long>")
    walked = keep(pieces.join(ends, "p").select("c", "p", "ats", "codes", "end").mapInArrow(_walked, f"{c}, p long, ats array<long>, codes array<int>, exits array<long>, edits binary"), "repair-walks")
    entries = in_order(walked, "exits").mapInArrow(_entries, "p long, entry int, tail int")
    steps = walked.join(entries, "p").select("ats", "codes", "edits", "entry", "tail").mapInArrow(_steps, "at long, code int, edit int, tail int")
    return rows.select(*KEY, "at").join(steps, "at")


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text, any others) -> a row per edit: conv_id, turn, code, edit (K, R, D or I), was (the role before), role, text, and one row with
    nothing but its conv_id at the head of each conversation. Rows of a conversation lie together in one partition, in order. conversations
    (conv_id): those to tell, where some of them may have no turns; by default those that have.

    Rows go by turn, null turns first; ties by role, the text's first characters and its MD5, repeated rows one by one. Nulls in role and text are one
    space; rows of a null conv_id are one conversation. Extra columns are left out. No rows give none. The code is 4 * class (0 system, 1 user,
    2 assistant, 3 other, by the role's first letter) + fault (1 blank, 2 duplicate, 3 truncated); both are null for insertions.
    """
    no = lambda kind: F.lit(None).cast(kind)
    steps = edits(turns).select(*KEY, F.lit(1).alias("kind"), "code", "edit", "tail", "at", no("string").alias("text"))
    texts = _keyed(turns).select(*KEY, F.lit(2).alias("kind"), *(no(k).alias(x) for x, k in (("code", "int"), ("edit", "int"), ("tail", "int"), ("at", "long"))), "text")
    heads = (turns if conversations is None else conversations).select(F.struct("conv_id").alias("c")).distinct()
    heads = heads.select("c", no(dict(turns.dtypes)["turn"]).alias("turn"), *(no(k).alias(x) for x, k in (("role", "string"), ("head", "string"), ("h", "binary"))), F.lit(0).alias("kind"), *(no(k).alias(x) for x, k in (("code", "int"), ("edit", "int"), ("tail", "int"), ("at", "long"), ("text", "string"))))
    # of each key its edits come first, then as many texts, all the same
    both = steps.unionByName(texts).unionByName(heads).repartition("c").sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "role", "head", "h", "kind", "at")
    kinds = dict(turns.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        taken, last = 0, 2
        for batch in batches:
            conv, turn, role, kind, code, edit, tail, text = (x.to_pylist() for x in (batch.column(0).flatten()[0], *batch.columns[1:]))
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for i in range(batch.num_rows):
                if kind[i] == 1:
                    if taken == len(waiting):
                        waiting, taken = [], 0
                    waiting.append((code[i], edit[i], tail[i]))
                    continue
                if kind[i] == 0:
                    last = 2
                    for o, x in zip(out, (conv[i], None, None, None, None, None, None), strict=True):
                        o.append(x)
                    continue
                mine, step, behind = waiting[taken]
                taken += 1
                # from the state before a row only one role can be inserted; the state is the last role that stayed
                done = [(None, None, "I", None) for _ in range(step // 3)] + [(turn[i], mine, "DKR"[step % 3], role[i])] + [(None, None, "I", None) for _ in range(behind)]
                for t, c, e, was in done:
                    new = role[i] if e == "K" else None if e == "D" else ROLES[int(last == 1)]
                    if e != "D":
                        last = 1 if new and new[0] == "u" else 2
                    for o, x in zip(out, (conv[i], t, c, e, was, new, text[i] if e in "KR" else "" if e == "I" else None), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type.field(0).type), pa.array(out[1], batch.column(1).type), pa.array(out[2], pa.int32()), *(pa.array(x, pa.string()) for x in out[3:])], ["conv_id", "turn", "code", "edit", "was", "role", "text"])

    return both.select("c", "turn", "role", "kind", "code", "edit", "tail", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, code int, edit string, was string, role string, text string")


class _Tally:
    """What digests() tells of a conversation, a row at a time."""

    def __init__(self, conv):
        self.conv, self.turns, self.last, self.low, self.high, self.before = conv, 0, None, None, None, None
        self.faults, self.illegal, self.cost, self.audit, self.sha, self.any = [0, 0, 0, 0], 0, 0, [], hashlib.sha256(), False

    def add(self, turn, code, edit, was, role, text) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": INSERT, "I": INSERT, "D": DELETE}[edit]
        if edit != "I":
            self.faults[code & 3] += 1
            self.cost += TRUNCATED if code & 3 == CUT and edit != "D" else 0
            first = was[:1]
            self.illegal += self.before is not None and self.before + first not in ("su", "ua", "au")
            self.before = first
            if turn is not None:
                self.turns += turn != self.last
                self.last, self.low, self.high = turn, turn if self.low is None else self.low, turn
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def digests(repaired: DataFrame) -> DataFrame:
    """Rows of repair() -> a row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A conversation passes through
    as a stream, of which only the edits' letters are kept."""
    kind = dict(repaired.dtypes)["conv_id"]
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, done = None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 9
            own = [pa.array(cols[0], id_type), *(pa.array(x, pa.int64()) for x in cols[1:7]), *(pa.array(x, pa.string()) for x in cols[7:])]
            done.clear()
            return pa.RecordBatch.from_arrays(own, ["conv_id", *longs, "audit", "repaired_sha256"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for conv, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if rest[2] is None:
                    if tally:
                        done.append(tally.row())
                    tally = _Tally(conv)
                else:
                    tally.add(*rest)
            if len(done) > 4096:
                yield out()
        if tally:
            done.append(tally.row())
            yield out()

    return repaired.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{x} long" for x in longs) + ", audit string, repaired_sha256 string")
