"""Chat formatting against plain Python: control strings, nulls, ties, repeated rows, trailing turns, clashing columns, no rows."""

import hashlib
import itertools
import random
import re

from tamis.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example long, last boolean"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    rng = random.Random(5)
    parts = ["\\", "\\\\", "#", "##", "###", " ", "<", "/turn>", "</turn>", "\n", ":", ": ", "assistant", "é", ""]
    out = [(i, n, rng.choice(["user", "assistant", "assistant", "system", "a: b", "c:", "### x"]), "".join(rng.choices(parts, k=rng.randrange(9)))) for i in range(60) for n in range(rng.randrange(1, 7))]
    out += [(100, None, "assistant", "no turn"), (100, 1, None, None), (100, 1, "assistant", None), (100, 1, "assistant", "#"), (100, 1, "assistant", "A"), (100, 1, "assistant", "A")]
    out += [(None, 0, "user", "u"), (None, 1, "assistant", "v"), (101, 0, "user", "only"), (102, 0, "assistant", "long ### " * 50000), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    return out


def plain():
    out = {}
    for conv, turns in itertools.groupby(sorted(rows(), key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(role or "", text or "") for _, _, role, text in turns]
        reply = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(reply), sha(reply))
    return out


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, 1, True) for r in rows()], SCHEMA)
    made = chat.expand(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}
    assert got == plain()
    for r in made.collect():
        n = r.text.count(chat.END)
        assert r.text.count("### ") == r.text.count("</turn>") == n, r.text[:200]
        assert r.loss_start is None or r.text[r.loss_end :] == chat.END


def test_other_text_stays_as_it_is(spark):
    code = "# Title\n#include <a.h>\n## Two\nx < y && \\n :: a\\b <turn> # ##"
    out = chat.expand(spark.createDataFrame([(1, 0, "assistant", code, 1, True)], SCHEMA)).first()
    assert out.text == f"### assistant: {code} </turn>\n" and re.fullmatch(re.escape(code), out.text[out.loss_start : out.loss_end])


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.expand(none).count() == 0 and chat.read_back(chat.expand(none)).count() == 0
