"""PII: identifiers against the stated patterns, terms against plain counting."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from tamis.llm import pii

from tests.llm.helpers import documents, texts


def stated(text):
    """The base as its patterns say, without any of the operator's shortcuts."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(d[::-1])]
        if 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_patterns():
    r = random.Random(1)
    made = ["".join(r.choice("ab@@..-+ 0123456789()é\n_%") for _ in range(60)) for _ in range(3000)]
    fixed = ["a@b.c@d.e", "x@y", "@b.c", "1.2.3.4.5.6.7.8", "300.1.1.1", "4012-8888 8888-1881", "+1 (974) 555-3436", "é@b.cd", "a@@b.c", "+1" + " " * 50]
    for t in made + fixed:
        assert pii.base_spans(t) == stated(t), t


def test_query_base(spark):
    want = dict(texts())
    rows = pii.digests(pii.find(documents(spark))).collect()
    assert len(rows) == len(want)
    for r in rows:
        own = stated(want[r.doc_id] or "")
        told = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in own]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in own) for x in range(4))
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == told


def test_terms_that_reveal(spark):
    rows = [(i, f"please ask Zelphira Quux at zq@mail.example.com about item number n{i}") for i in range(5)]
    rows += [(100 + i, f"please ask somebody else about item number {i} at noon") for i in range(2000)]
    rows += [(5000, "Zelphira was here"), (5001, None), (5002, "")]
    found = pii.digests(pii.find(documents(spark, rows), min_bits=8.0)).collect()
    spans = {r.doc_id: r.spans for r in found}
    assert spans[5000] == "term:0:8" and spans[100] == "" and spans[5001] == ""
    assert spans[0].startswith("email:28:47") and "term:11:19" in spans[0]
    clean = {r.doc_id: r.text for r in pii.sanitised(documents(spark, rows), min_bits=8.0).collect()}
    assert clean[5000] == "<term> was here" and clean[5001] is None and "<email>" in clean[0] and clean[100] == rows[5][1]
    assert len(clean) == len(rows)


def test_repeated_rows_and_columns(spark):
    rows = [(1, "mail a@b.cd now"), (1, "mail a@b.cd now"), (None, "mail a@b.cd now"), (None, None)]
    docs = documents(spark, rows)
    assert pii.find(docs).count() == 4
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and sorted(str(r.text) for r in out.collect()) == ["None"] + ["mail <email> now"] * 3
    assert pii.find(docs.limit(0)).count() == 0


FILLER = "amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge marsh notch oasis plain quarry ridge slope tundra upland vale woods yard zone brook cliff dune field glade".split()


def prose(r, n):
    """Frequent words, and one word that no other text has."""
    own = [r.choice(FILLER) for _ in range(n)]
    own.insert(r.randrange(n), "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(5)))
    return own


@pytest.mark.parametrize("size", [10, 10_000])
def test_names_and_rare_words(spark, size):
    """A name that keeps standing near an address is found in small and large tables, wherever it stands; words that are only rare stay."""
    r, rows = random.Random(size), []
    for i in range(size):
        words = prose(r, 100)
        if i < 5:
            words[30:30] = ["Quuxley", "hot@mail.example.com"]
        elif i % 3 == 0:
            words[30:30] = [f"user{i}@mail.example.com"]
        rows.append((i, " ".join(words)))
    rows[5] = (5, rows[5][1] + " ask Quuxley then")
    docs = documents(spark, rows)
    found = {x.doc_id: x.spans for x in pii.digests(pii.find(docs)).collect()}
    terms = {(i, rows[i][1][int(a) : int(b)]) for i, spans in found.items() for kind, a, b in (x.split(":") for x in spans.split(",") if x) if kind == "term"}
    assert terms == {(i, "Quuxley") for i in range(6)}


def test_copies_are_no_evidence(spark):
    """What stands in many copies of one text has been seen in one place."""
    r = random.Random(7)
    rows = [(i, " ".join(prose(r, 60))) for i in range(300)]
    text = "Quuxley " + " ".join(prose(r, 20)) + " Zelphira zq@mail.example.com " + " ".join(prose(r, 20))
    found = pii.digests(pii.find(documents(spark, rows + [(1000 + i, text) for i in range(50)]))).collect()
    assert all(x.n_term == 0 for x in found) and sum(x.n_email for x in found) == 50


def test_terms_against_counting(spark):
    """Every figure counted plainly over whole texts, and the same rule applied to it."""
    r, rows = random.Random(11), []
    for i in range(400):
        words = prose(r, 40)
        for k, name in enumerate(("Aldora", "Brimwick", "Corvane")):
            if r.random() < 0.06:
                at = r.randrange(30)
                words[at:at] = [name, *(["x"] * r.choice([0, 9])), f"{name.lower()[:2]}{k % 2}@mail.example.com"]
            elif r.random() < 0.01 * k:
                words.append(name)
        rows.append((i, " ".join(words)))
    n, words = len(rows), sum(t.count(" ") + 1 for _, t in rows)
    pairs, n_e, n_t = defaultdict(list), Counter(), Counter()
    for _, t in rows:
        own = pii.around(t, pii.base_spans(t), 6)
        n_e.update({e for e, _ in own})
        n_t.update(set(pii.TERM.findall(t.lower())))
        for pair, place in own.items():
            pairs[pair].append(place)
    near = Counter(e for (e, _), places in pairs.items() for _ in set(places))
    need = math.log2(words * len(near) / 0.1)
    want = set()
    for (e, x), places in pairs.items():
        c, other = len(set(places)), max(0, n_t[x] - len(places))
        m = c + other
        ways = min(k * math.log2(math.e * m / k) - math.log2(2 * math.pi * k) / 2 if k else 0 for k in (c, other))
        tells, holds = math.log2(n * len(places) / (n_t[x] * n_e[e])), math.log2(n / n_e[e])
        if tells >= holds / 2 > 0 and len(places) >= 0.6 * n_t[x] and c * math.log2(words / near[e]) - ways >= need:
            want.add(x)
    found = pii.digests(pii.find(documents(spark, rows))).collect()
    texts = dict(rows)
    got = {texts[x.doc_id][int(a) : int(b)].lower() for x in found for kind, a, b in (y.split(":") for y in x.spans.split(",") if y) if kind == "term"}
    assert got == want and want


def test_window_is_words(spark):
    text = "Zelphira" + " " * 400 + "zq@mail.example.com" + " " * 400 + "Quuxley"
    assert set(pii.around(text, pii.base_spans(text), 6)) == {("email:zq@mail.example.com", "zelphira"), ("email:zq@mail.example.com", "quuxley")}
