"""Conversation repair against a plain programme over whole conversations and against its SQL, with stretches of two places and of all."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from tamis.llm import repair
from tamis.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, at string, code int"
LAST = re.compile(r"[.!?][ \t-\r]*\Z")


def plain(rows, ids):
    """rows (conv, turn, role, text), undamaged -> what the query returns, from edits of whole conversations, cheapest and least first."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv in ids:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:24], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            faults.append(1 if not re.search(r"[^ \t-\r]", text) else 2 if (role, text) in seen else 0 if LAST.search(text) else 3)
            seen.add((role, text))
        best = {"": (0, "", [])}  # the last initial of what is there -> the cheapest
        offer = lambda d, k, v: d.update({k: min(d.get(k, v), v, key=lambda x: x[:2])})
        follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}

        def inserted(best):
            for _ in range(2):
                for last, (cost, audit, said) in list(best.items()):
                    offer(best, follow[last][0], (cost + 3, audit + "I", [*said, follow[last] + ":"]))
            return best

        for (_, role, text), fault in zip(own, faults, strict=True):
            after = {}
            for last, (cost, audit, said) in inserted(best).items():
                offer(after, last, (cost + 4, audit + "D", said))
                if fault not in (1, 2):
                    more = 3 * (fault == 3)
                    if role[:1] == "s" and last == "" or role[:1] == follow[last][0]:
                        offer(after, role[:1], (cost + more, audit + "K", [*said, f"{role}:{text}"]))
                    offer(after, follow[last][0], (cost + more + 3, audit + "R", [*said, f"{follow[last]}:{text}"]))
            best = after
        cost, audit, said = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda x: x[:2])
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def made():
    rng, rows = random.Random(4), []
    texts = ["Yes.", "No", "", " \t", None, "Why?", "Same.", "Same.", "a" * 40 + ".", "a" * 40 + "!", "x.  \n", "é日.", ". x"]
    for conv in [*range(120), None]:
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += [(500, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"{t}.", f"{t}!", f"{t}"])) for t in range(700)]
    rows += [(501, 1, "user", "Again.")] * 90 + [(502, None, "user", "Null.")] * 3
    gone = next(i for i in range(600, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Gone.")]


@pytest.mark.parametrize("stretch", [2, 64, 1 << 14])
def test_query(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rows = made()
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    want = plain(rows, {r[0] for r in rows})
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    if stretch == 64:
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
        assert sorted(con.sql(ORACLES["op11_conversation_repair"]).fetchall(), key=repr) == sorted(want, key=repr)


def test_rows(spark):
    """The repaired rows themselves: what goes, what is inserted, what changes its role."""
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "system", "Odd."), (2, 0, "assistant", "So.")], "conv_id long, turn long, role string, text string")
    got = {c: [(r.turn, r.edit, r.was, r.role, r.text) for r in repair.repair(turns).collect() if r.edit and r.conv_id == c] for c in (1, 2)}
    assert got[1] == [(0, "K", "user", "user", "Hi."), (1, "D", "user", None, None), (None, "I", None, "assistant", ""), (2, "K", "user", "user", "Hello?"), (3, "R", "system", "assistant", "Odd.")]
    assert got[2] == [(None, "I", None, "user", ""), (0, "K", "assistant", "assistant", "So.")]


def test_empty(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert repair.repair(turns).count() == 0 and repair.digests(repair.repair(turns)).count() == 0
