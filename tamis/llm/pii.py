"""PII by information-theoretic sanitisation.

Identifiers (mail and IP addresses, card and phone numbers) are found by rule and are the protected entities. Corpus co-occurrence then
tells how strongly a term reveals one: with n documents in all, n_e that hold the entity, n_t that hold the term and n_te where the term
stands near the entity, the term discloses log2(n n_te / (n_t n_e)) of the log2(n / n_e) bits that the entity holds, and the entity's posterior
is n_te / n_t. A term over both thresholds, a share of those bits and a posterior, is sanitised wherever it occurs: it is generalised to its
kind of entity.

Both are estimates, and a word that is rare anyway has a posterior of 1 wherever it happens to stand. So a term also needs evidence. Were words strewn
at random, each would stand near the entity with a chance q, the share of all words that do; that a term does so in c different surroundings and
elsewhere in m - c documents has a probability of at most C(m, c) q^c. A term counts if that, times the number of pairs of words and entities, is under
`chance`: the number of terms that the whole table may sanitise for nothing. One occurrence is never evidence, and neither are copies of
one text, whose surroundings are the same; a few are, the fewer the larger the table or the longer its texts, without a least number.

Three passes over the texts. The first finds identifiers and the terms around them. The second counts in how many texts those terms stand for which
there can be evidence, the third places those that reveal an entity. Which terms to count or to place the workers know by a bitmap of a fixed size
over their hashes; false hits of it fall out of the exact joins behind.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bitmap, keep, ship, slices

KINDS = ("email", "ip", "card", "phone", "term")
#: The rules. Those for mail addresses go by their @, so long runs of letters cost no more than their length.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_][\w'-]*[^\W_]")
LOCAL_CHARS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end if m else 0))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) of each identifier, in code points, by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= len(m[0]) <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entity(kind: int, value: str) -> str:
    """An identifier without the ways to write it."""
    return KINDS[kind] + ":" + (value.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", value))


def around(text: str, spans: list[tuple[int, int, int]], window: int) -> dict[tuple[str, str], int]:
    """(entity, term) for the terms among the `window` words before and behind each identifier, identifiers themselves left out, and a hash of
    the surroundings in which it stands first."""
    out, end, parts = {}, 0, []
    for _, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if b > end:
            parts += [text[end : max(a, end)], " " * (b - max(a, end))]
            end = b
    blank = "".join(parts) + text[end:]
    terms = [(m.start(), m[0].lower()) for m in TERM.finditer(blank)]
    for kind, a, b in spans:
        e, at = entity(kind, text[a:b]), bisect_left(terms, (a,))
        own = [x for _, x in terms[max(0, at - window) : at + window]]
        place = xxhash.xxh64_intdigest(" ".join(own).encode()) - (1 << 63)
        for x in own:
            out.setdefault((e, x), place)
    return out


def text_key(text: Column) -> Column:
    """With the id it names a row: rows that share both are copies of one another."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("h"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 6, support: int = 1, min_bits: float = 0.0, posterior: float = 0.6, bits: int = 22, share: float = 0.5, chance: float = 0.1) -> DataFrame:
    """docs -> id, h, spans (array of struct kind int, start int, end int; by kind, then start): a row for each row of docs.

    Null and empty texts have no spans. Rows that share id and text have the same spans; near an entity they count once. Spans of
    terms never overlap identifiers. share: of the entity's own bits, what a term has to disclose. support: documents in which a term has to
    stand near an entity, min_bits: bits that it has to disclose besides; neither holds anything back unless given. chance: how many terms of the whole
    table chance alone may bring. An entity in all rows has no bits to disclose. bits: log2 of the bitmap's size.
    """
    spark = docs.sparkSession
    ship(spark)
    source, kind = _source(docs, key, text), dict(docs.dtypes)[key]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            spans, pairs, n = [], [], []
            for t in batch.column(2).to_pylist():
                own = base_spans(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                pairs.append([{"entity": e, "term": x, "place": p} for (e, x), p in sorted(around(t, own, window).items())] if own else [])
                n.append(t.count(" ") + t.count("\n") + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")]))), pa.array(pairs, pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("place", pa.int64())]))), pa.array(n, pa.int64())], ["id", "h", "spans", "near", "words"])

    first = keep(source.mapInArrow(scan, f"id {kind}, h long, spans array<struct<kind:int,start:int,end:int>>, near array<struct<entity:string,term:string,place:bigint>>, words long"), "pii-scan")
    distinct = first.filter(F.size("spans") > 0).dropDuplicates(["id", "h"])
    near = keep(distinct.select(F.explode("near").alias("x")).groupBy("x.entity", "x.term", "x.place").agg(F.count("*").alias("n")), "pii-near")
    entities = near.groupBy("entity").agg(F.count("*").alias("around"))
    total, words = (float(max(1, x or 0)) for x in first.agg(F.count("*"), F.sum("words")).first())
    need = F.log2(F.lit(words) * max(1, entities.count()) / chance)
    seen = near.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("c")).filter(F.col("n_te") >= support)
    # even if it stood nowhere else, c surroundings would have to be evidence
    rare = F.log2(F.lit(words) / F.least(F.col("around"), F.lit(words)))
    seen = keep(seen.join(entities, "entity").withColumn("rare", rare).filter(F.col("c") * F.col("rare") >= need), "pii-candidates")
    shift = np.uint64(64 - bits)

    def hits(batches: Iterable[pa.RecordBatch], own: np.ndarray) -> Iterator[tuple[pa.RecordBatch, list[str], dict[str, bool]]]:
        """Batches, their texts in lower case, and whether the bitmap has a term."""
        hit: dict[str, bool] = {}
        for batch in slices(batches, 2) if own.any() else ():
            if len(hit) > 500_000:
                hit.clear()
            texts = []
            for t in batch.column(2).to_pylist():
                low = t.lower()
                if len(low) != len(t):  # a letter that grows in lower case would move the places
                    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in t)
                texts.append(low)
                if new := [x for x in set(TERM.findall(low)) if x not in hit]:
                    at = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in new), np.uint64, len(new)) >> shift
                    hit.update(zip(new, ((own[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).tolist(), strict=True))
            yield batch, texts, hit

    candidates = spark.sparkContext.broadcast(bitmap(seen.select(F.xxhash64("term").alias("h")).distinct(), bits))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])
        for _, texts, hit in hits(batches, candidates.value):
            for t in texts:
                n.update(x for x in set(TERM.findall(t)) if hit.get(x))
            if len(n) > 500_000:
                yield told()
                n.clear()
        if n:
            yield told()

    n_e = distinct.select("id", "h", F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    n_t = source.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    known = seen.join(n_e, "entity").join(n_t, "term")
    tells = F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    holds = F.log2(F.lit(total) / F.col("n_e"))
    c, others = F.col("c"), F.greatest(F.lit(0), F.col("n_t") - F.col("n_te"))
    every = c + others
    # log2 of the number of ways to choose k of them, from above, by Stirling's bound on k!
    choose = lambda k: F.when(k > 0, k * F.log2(F.lit(np.e) * every / k) - F.log2(F.lit(2 * np.pi) * k) / 2).otherwise(F.lit(0.0))
    ways = F.least(choose(c), choose(others))
    enough = (holds > 0) & (tells >= share * holds) & (tells >= min_bits) & (F.col("n_te") >= posterior * F.col("n_t")) & (c * F.col("rare") - ways >= need)
    known = keep(known.filter(enough).select("term").distinct(), "pii-terms")
    revealing = spark.sparkContext.broadcast(bitmap(known.select(F.xxhash64("term").alias("h")), bits))

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, hit in hits(batches, revealing.value):
            out: tuple[list, ...] = ([], [], [])
            for row, t in enumerate(texts):
                found: dict[str, list] = {}
                for m in TERM.finditer(t) if any(hit.get(x) for x in set(TERM.findall(t))) else ():
                    if hit.get(m[0]):
                        found.setdefault(m[0], []).append({"start": m.start(), "end": m.end()})
                for x, at in found.items():
                    out[0].append(row), out[1].append(x), out[2].append(at)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "h", "term", "at"])

    second = source.mapInArrow(places, f"id {kind}, h long, term string, at array<struct<start:int,end:int>>").dropDuplicates(["id", "h", "term"])
    spans = second.join(known, "term", "left_semi").select("id", "h", F.explode("at").alias("x")).groupBy("id", "h").agg(F.collect_list("x").alias("more"))
    spans = spans.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "more")
    rows = first.join(spans, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    terms = F.filter(F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), lambda x: F.struct(F.lit(4).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), lambda x: ~F.exists("spans", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return rows.select("id", "h", F.array_sort(F.concat("spans", terms)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """find()'s rows -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    name = F.array(*map(F.lit, KINDS))
    base = F.filter("spans", lambda x: x["kind"] < 4)
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias("n_" + KINDS[k])
    return found.select(F.col("id").alias("doc_id"), *map(n, range(4)), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), n(4))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the text's spans generalised to `<email>`, `<ip>`, `<card>`, `<phone>` and `<term>`; all columns and rows stay, null texts
    too. Where identifiers overlap, one mark with the first one's kind covers them. Only rows with spans are joined to the plan's rows."""
    ship(docs.sparkSession)
    found = find(docs, key, text, **options).filter(F.size("spans") > 0).dropDuplicates(["id", "h"]).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    rows = docs.join(found, docs[key].eqNullSafe(found["__id"]) & (text_key(docs[text]) == found["__h"]), "left")

    @F.pandas_udf("string")
    def marked(texts, spans):
        out = []
        for t, own in zip(texts, spans, strict=True):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            parts, end = [], 0
            for x in sorted(own, key=lambda x: (x["start"], -x["end"])):
                if x["start"] >= end:
                    parts += [t[end : x["start"]], f"<{KINDS[x['kind']]}>"]
                end = max(end, x["end"])
            out.append("".join(parts) + t[end:])
        return texts.__class__(out, dtype=object)

    new = F.when(F.col("__spans").isNull(), docs[text]).otherwise(marked(docs[text], F.col("__spans")))
    return rows.select(*(new.alias(c) if c == text else docs[c] for c in docs.columns))
