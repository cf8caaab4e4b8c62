"""Quality rules: the base against plain Python, distances against the formula."""

import math
import random
from collections import Counter

import pytest
from tamis.llm import quality

import regex

from tests.llm.helpers import documents, texts

CLASSES = (r"\p{Ll}|\p{Lo}", r"\p{Lu}", "[0-9]", None, r"""[.,;:!?'"()\-]""", r"[#*$%&|<>]")


def histograms(text, lang):
    """Counts by class of character, and of the common words of the language and all others."""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    chars = [len(regex.findall(p, text)) if p else len(text) - sum(map(len, words)) for p in CLASSES]
    own, n = quality.COMMON.get(lang), Counter(w.rstrip(".,;:").lower() for w in words)
    return [*chars, max(0, len(text) - sum(chars))], own and [n[w] for w in own] + [len(words) - sum(n[w] for w in set(own))]


def js(a, b):
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_verdicts(spark):
    """Both distances and the verdict of every document, repeated rows included, against plain Python."""
    rows = documents(spark, more=texts()[:3]).select("doc_id", "text", "lang").collect()
    found = [(r.doc_id, r.lang, r.text or "", histograms(r.text or "", r.lang), base(r.text)) for r in rows]
    add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    chars, common, every = {}, {}, [0] * 7
    for _, lang, _, (c, w), b in found:
        if not b[-1]:
            chars[lang], every = add(chars.get(lang, [0] * 7), c), add(every, c)
            common[lang] = w and add(common.get(lang, [0] * len(w)), w)
    limits, want = quality.Limits(), []
    for i, lang, text, (c, w), b in found:
        ref = chars.get(lang) and add(chars[lang], [limits.prior_chars * x / sum(every) for x in every])
        near = (js(c, ref) if ref and len(text) >= limits.min_chars else None, js(w, common[lang]) if w and common.get(lang) and b[0] >= limits.min_words else None)
        bins = sum(x > 0 for x in common[lang]) - 1 if near[1] is not None else 0
        limit = math.sqrt(limits.word_distance**2 + (bins + limits.word_spread * math.sqrt(2 * bins)) / (8 * math.log(2) * max(1, b[0])))
        want.append((i, not b[-1] and (near[0] or 0) <= limits.char_distance and (near[1] or 0) <= limit, *near))
    got = [(r.doc_id, r.kept, r.char_distance, r.word_distance) for r in quality.judge(documents(spark, more=texts()[:3])).collect()]
    key = lambda r: (r[0], r[1])
    for g, x in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == x[:2] and g[2:] == pytest.approx(x[2:], abs=1e-6), (g, x)
    assert {k for _, k, *_ in want} == {True, False} and any(w is not None for *_, w in want) and any(w is None and k for _, k, _, w in want)


def base(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = len({j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)})
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed


def test_base(spark):
    rows = quality.judge(documents(spark)).collect()
    want = dict(texts())
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(want[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def test_exact_form_agrees(spark):
    docs = documents(spark)
    df = docs.select("doc_id", quality.words(docs["text"]).alias("w"))
    out = df.select("w", quality.repeated_words(df["w"]).alias("a"), quality.repeated_words(df["w"], exact=True).alias("b")).filter("size(w) > 3").collect()
    assert out and all(r.a == r.b for r in out)


def test_symbols_are_rejected_and_prose_is_kept(spark):
    rng = random.Random(3)  # mixed words: no window comes twice, so that only the histograms decide
    often, rare = "the of and to in a is that it for on was as with be by are this".split(), "river house winter garden letter morning stone bridge paper window".split()
    clean = [(i, " ".join(rng.choice(often) if rng.random() < 0.5 else rng.choice(rare) + rng.choice(rare) for _ in range(120)) + ".") for i in range(12, 1212, 6)]
    bad = [(6, " ".join(f"w{j}#### %%%%{j} $$$&&&" for j in range(80)))]
    out = {r.doc_id: r.kept for r in quality.judge(documents(spark, clean + bad)).collect()}
    assert not out[6] and all(out[i] for i, _ in clean)


@pytest.mark.parametrize(("a", "b"), [([1, 2, 3], [3, 2, 1]), ([5, 0], [0, 5]), ([2, 2], [4, 4])])
def test_distance(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    assert df.select(quality.distance(df.a, df.b).alias("d")).first().d == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_empty(spark):
    assert quality.judge(documents(spark, []).limit(0)).count() == 0


def test_words_decide(spark):
    """Lists of rare words go though their characters are right; prose as short as it may be stays, whatever chance does to its words."""
    r = random.Random(5)
    common, rare = quality.COMMON["en"][:20], ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(rare) for _ in range(n))
    rows = [(i, prose(r.choice([60, 200, 900]))) for i in range(600)] + [(1000 + i, " ".join(r.choice(rare) for _ in range(300))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.kept, x.char_distance) for x in quality.judge(docs).collect()}
    assert all(got[i][0] for i, _ in rows if i < 1000) and not any(got[i][0] for i, _ in rows if i >= 1000) and max(c for _, c in got.values() if c) < quality.Limits().char_distance
