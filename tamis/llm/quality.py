"""Quality rules: distribution divergence from language references. DataFrame functions only.

Two histograms describe a document: its characters by class, and its common words, one bin for each word of a short list of its language
and one for all other words. The same counts summed over all documents of a language that pass the base make that language's reference, by one
rule at every size: to the characters a fixed weight of those of all languages is added, which a small language leans on. A document is
kept if the Jensen-Shannon distances of both histograms from the references stay under their limits; a histogram over too few
characters or words is not judged.

Few words drawn from the reference itself lie at some distance from it by chance: of n words in k bins the squared distance has about the mean
(k - 1) / (8 n ln 2) and the spread sqrt(2 (k - 1)) / (8 n ln 2). The limit for words adds what chance explains to what a document may really differ by.

Texts are read once: all counts of a document come from one projection, and only those counts, some forty numbers, are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import keep, words

#: Common words by language.
COMMON = {
    "en": "the of and to in a is that it for on was as with be by are this or from at not he she they we you an have has".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son elle ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
#: The symbols that the base counts, and punctuation.
SYMBOLS, PUNCTUATION = r"[#*$%&|<>]", r"""[.,;:!?'"()\-]"""
CHARS = ("letter", "upper", "digit", "space", "punctuation", "symbol", "other")


@dataclass(frozen=True)
class Limits:
    min_chars: int = 200  # fewer characters: their histogram is not judged
    min_words: int = 50  # fewer words: likewise, and the base rule fails
    char_distance: float = 0.25
    word_distance: float = 0.2  # beyond what chance explains
    word_spread: float = 4.0  # spreads of that chance that are allowed for
    prior_chars: float = 10_000.0  # characters that all languages together add to a language's own
    repeat_percent: int = 50


def repeated_words(w: Column, exact: bool = False) -> Column:
    """How many words of an array stand in a window of three that it holds twice or more, the first included.

    Windows are hashed to 46 bits over an 18-bit place and sorted as plain numbers, so equal ones stand side by side. Should two windows
    side by side share a hash but differ, or the places not fit, the exact form sorts the windows themselves.
    """
    n = F.size(w) - 2
    places = F.sequence(F.lit(0), n - 1)
    three = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    if exact:
        rows = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("k"), i.alias("i"))))
        pairs = lambda s: F.filter(F.sequence(F.lit(1), n - 1), lambda j: F.get(s, j)["k"] == F.get(s, j - 1)["k"])
        place = lambda s, j: F.get(s, j)["i"]
    else:
        rows = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.xxhash64(*three(i)), 18).bitwiseOR(i.cast("long"))))
        pairs = lambda s: F.filter(F.sequence(F.lit(1), n - 1), lambda j: F.shiftright(F.get(s, j), 18) == F.shiftright(F.get(s, j - 1), 18))
        place = lambda s, j: F.get(s, j).bitwiseAND(F.lit(2**18 - 1)).cast("int")
    struct = lambda s: F.struct(s.alias("s"), pairs(s).alias("j"))
    covered = lambda x: F.aggregate(
        F.sort_array(F.array_distinct(F.flatten(F.transform(x["j"], lambda j: F.array(place(x["s"], j - 1), place(x["s"], j)))))),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"])
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  a name for a value inside an expression
    if exact:
        return bind(rows, lambda s: bind(struct(s), covered))
    differ = lambda x: F.exists(x["j"], lambda j: bind(place(x["s"], j), lambda p: bind(place(x["s"], j - 1), lambda q: F.struct(*three(p)) != F.struct(*three(q)))))
    fast = bind(rows, lambda s: bind(struct(s), lambda x: F.when(~differ(x), covered(x))))
    return F.when(n < 2, F.lit(0)).otherwise(F.coalesce(F.when(n < 2**18, fast), repeated_words(w, True))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, lang, the base counts, and arrays `chars` and `common` of counts. A null text is empty."""
    rows = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    listed = sorted({x for own in COMMON.values() for x in own})
    plain = F.transform("w", lambda x: F.lower(F.rtrim(x, F.lit(".,;:"))))
    hits = F.concat(F.lit(" "), F.array_join(F.filter(plain, lambda x: x.isin(listed)), "  "), F.lit(" "))
    rows = rows.select(
        "doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(PUNCTUATION)).alias("punctuation"), F.regexp_count("text", F.lit(r"\p{Lu}")).alias("upper"), F.regexp_count("text", F.lit("[0-9]")).alias("digit"), F.regexp_count("text", F.lit(r"\p{Ll}|\p{Lo}")).alias("letter"), hits.alias("hits"))
    found = lambda x: ((F.length("hits") - F.length(F.replace("hits", F.lit(f" {x} "), F.lit("")))) / (len(x) + 2)).cast("long")
    most = max(map(len, COMMON.values()))
    counts = F.lit(None).cast("array<bigint>")
    for lang, own in COMMON.items():
        own = [*own, *[None] * (most - len(own))]
        counts = F.when(F.col("lang") == lang, F.array(*(found(x) if x else F.lit(0).cast("long") for x in own))).otherwise(counts)
    space, symbol = F.col("n_chars") - F.col("word_chars"), F.col("n_symbols")
    known = F.col("letter") + F.col("upper") + F.col("digit") + space + F.col("punctuation") + symbol
    chars = F.array(*(x.cast("long") for x in (F.col("letter"), F.col("upper"), F.col("digit"), space, F.col("punctuation"), symbol, F.greatest(F.lit(0), F.col("n_chars") - known))))
    rows = rows.withColumn("c", counts)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    common = F.when(F.col("c").isNotNull(), F.concat("c", F.array(F.greatest(F.lit(0), F.col("n_words") - total(F.col("c"))).cast("long"))))
    return rows.select("doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), common.alias("common"))


def references(rows: DataFrame) -> DataFrame:
    """measured rows -> a row for each language: lang, `ref_chars` and `ref_common`; summed by task before the shuffle."""
    bins = max(map(len, COMMON.values())) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CHARS))] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(bins)]
    by = rows.groupBy("lang").agg(*sums)
    arrays = F.array(*(F.col(f"c{i}") for i in range(len(CHARS)))).alias("ref_chars"), F.array(*(F.col(f"w{i}") for i in range(bins))).alias("ref_common")
    return by.select("lang", *arrays)


def distance(a: Column, b: Column) -> Column:
    """The Jensen-Shannon distance, 0 to 1, of two arrays of counts; null if either is null or empty in sum."""
    share = lambda x: F.transform(x, lambda y: y / F.nullif(F.aggregate(x, F.lit(0.0), lambda s, z: s + z), F.lit(0.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
    terms = F.zip_with(share(a), share(b), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs (doc_id, text, lang, any others) -> doc_id, the base counts, base_failed, char_distance, word_distance, kept; a row for each row.

    base_failed: under min_words words, or over repeat_percent percent of them in repeated windows. kept is false then; else it is false
    where a judged distance exceeds its limit. A null language is a language; languages without a list of common words are judged by
    characters alone. Empty texts fail the base. Repeated rows are rows, and count as often. No rows give none.
    """
    rows = measured(docs)
    rows = keep(rows.withColumn("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))), "quality")
    refs = keep(references(rows.filter("NOT base_failed")), "quality-refs")
    # languages are few beside documents; Spark broadcasts their rows only where it measures them as small, and else splits the hot ones
    every = refs.agg(*(F.sum(F.get("ref_chars", F.lit(i))).alias(f"c{i}") for i in range(len(CHARS)))).select(F.array(*(f"c{i}" for i in range(len(CHARS)))).alias("all_chars"))
    share = F.transform("all_chars", lambda x: x / F.aggregate("all_chars", F.lit(0.0), lambda s, z: s + z))
    smoothed = F.zip_with("ref_chars", share, lambda x, y: x + limits.prior_chars * y)
    refs = refs.crossJoin(F.broadcast(every)).select(F.col("lang").alias("ref_lang"), smoothed.alias("ref_chars"), "ref_common")
    rows = rows.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    rows = rows.withColumns({
        "char_distance": F.when(F.col("n_chars") >= limits.min_chars, distance(F.col("chars"), F.col("ref_chars"))),
        "word_distance": F.when(F.col("n_words") >= limits.min_words, distance(F.col("common"), F.col("ref_common"))),
    })
    bins = F.size(F.filter("ref_common", lambda x: x > 0)) - 1
    chance = (bins + limits.word_spread * F.sqrt(2 * bins)) / (8 * math.log(2) * F.col("n_words"))
    word_limit = F.sqrt(limits.word_distance**2 + chance)
    far = (F.coalesce("char_distance", F.lit(0.0)) > limits.char_distance) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")
