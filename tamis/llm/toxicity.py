"""Toxicity by classifier chains.

The categories are predicted one after the other. Each has a linear model over words and word stems (the first characters of a word, since
toxic words are inflected), and over the probabilities of all earlier categories;
in training those are out-of-fold predictions, made by models that have not seen the row, so that a later model learns how far to trust them.

Fitting takes a bounded, documented sample of labelled rows. Spark counts words and stems by category and fold over the sample and keeps the most
telling ones, for each fold's model those that tell in the other folds, so that out-of-fold predictions have not seen their row in any way. The
sample's rows of those, a matrix of a fixed size, are fitted by Newton's method. All documents are then scored in one pass, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import free, keep, ship, slices

TOKEN = re.compile(r"\w+")
#: Lengths of stems; a stem is written with a star.
STEMS = (3, 4, 5, 6)


def features(text: str | None) -> set[str]:
    """The words of a text in lower case, and their stems."""
    words = set(TOKEN.findall((text or "").lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


class Lookup:
    """The numbers of the listed features that a text has; stems are looked up without writing their stars."""

    def __init__(self, listed: tuple[str, ...]):
        self.words = {w: i for i, w in enumerate(listed) if not w.endswith("*")}
        self.stems = [(k, {w[:-1]: i for i, w in enumerate(listed) if w.endswith("*") and len(w) == k + 1}) for k in STEMS]

    def row(self, text: str | None) -> np.ndarray:
        words = set(TOKEN.findall((text or "").lower()))
        out = {self.words[w] for w in self.words.keys() & words}
        for k, own in self.stems:
            if own:
                out.update(own[w] for w in own.keys() & {w[:k] for w in words if len(w) > k})
        return np.array(sorted(out), np.int64)


@dataclass(frozen=True)
class Options:
    sample: int = 20_000  # labelled rows to fit on, at most: those whose ids have the least hashes
    vocabulary: int = 256  # features, at most
    min_docs: int = 8  # in so many texts of the sample a feature has to stand
    min_score: float = 6.0  # standard deviations that its count in a category is off
    folds: int = 5
    ridge: float = 0.02
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]  # by category: for the words, the earlier categories and the intercept

    def chances(self, rows: list[np.ndarray]) -> np.ndarray:
        """Rows as numbers of the words they hold -> the categories' probabilities, by chain."""
        out = np.zeros((len(rows), len(self.categories)))
        n, at = np.fromiter(map(len, rows), np.int64, len(rows)), np.concatenate([np.zeros(0, np.int64), *rows])
        owner = np.repeat(np.arange(len(rows)), n)
        for j, w in enumerate(self.weights):
            z = np.bincount(owner, w[at], len(rows)) + out[:, :j] @ w[len(self.words) : len(self.words) + j] + w[-1]
            out[:, j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton's method. One class only: the intercept alone."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _counted(batches: Iterable[pa.RecordBatch], categories: int) -> Iterator[pa.RecordBatch]:
    """Labelled texts (text, fold, a mark for each category) -> feature, fold, texts that have it, and those of them by category; summed in the worker."""
    found: dict[int, list[Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for fold, (n, *hits) in found.items():
            marks = [[float(c[w]) for c in hits] for w in n]
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([fold] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array(marks, pa.list_(pa.float64()))], ["word", "fold", "n", "hits"])
        found.clear()

    for batch in slices(batches, 0):
        for text, fold, *marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, *hits = found.setdefault(fold, [Counter() for _ in range(1 + categories)])
            own = features(text)
            n.update(own)
            for c, mark in zip(hits, marks, strict=True):
                if mark:
                    c.update(own)
        if sum(len(x[0]) for x in found.values()) > 50_000:
            yield from told()
    yield from told()


def _telling(counts: DataFrame, n: list[int], hits: list[list[float]], categories: tuple[str, ...], o: Options, fold: int | None) -> tuple[str, ...]:
    """The most telling features of the sample, without a fold if one is given. counts: word, n, a count for each category, and the same by fold."""
    less = lambda c: F.col(c) if fold is None else F.col(c) - F.col(f"{c}{fold}")
    rows, off = sum(n) - (n[fold] if fold is not None else 0), []
    for j, own in enumerate(hits):
        share = (sum(own) - (own[fold] if fold is not None else 0.0)) / max(rows, 1)
        off.append((less(f"c{j}") - less("n") * share) / F.sqrt(less("n") * max(share * (1 - share), 1e-9)))
    score = F.greatest(*map(F.abs, off), F.lit(0.0))
    top = counts.filter(less("n") >= o.min_docs).select("word", score.alias("score")).filter(F.col("score") >= o.min_score)
    return tuple(r.word for r in top.orderBy(F.col("score").desc(), "word").limit(o.vocabulary).collect())


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], o: Options = Options(), key: str = "doc_id", text: str = "text") -> Model:
    """docs (key, text), labels (key and a column of 0 or 1 for each category, in the order of the chain) -> the chain.

    Labels without a document and rows with a null label are left out; of repeated keys one labelled text is taken, and equal texts count once.
    """
    said = labels.select(F.col(key).alias("id"), *(F.col(c).cast("double").alias(c) for c in categories)).dropna().dropDuplicates(["id"])
    said = said.orderBy(F.xxhash64("id"), "id").limit(o.sample)  # bounded: ids and labels
    source = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ship(docs.sparkSession)
    rows = source.join(F.broadcast(said), "id")
    sample = rows = keep(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("id", "text", *categories)).alias("x")).select("x.*"), "toxic-sample")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(o.folds)).cast("int"))
    sums = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"c{j}") for j, c in enumerate(categories))).collect()}
    n = [sums[f].n if f in sums else 0 for f in range(o.folds)]
    hits = [[sums[f][f"c{j}"] if f in sums else 0.0 for f in range(o.folds)] for j in range(len(categories))]
    k = len(categories)
    by_word = rows.select("text", "fold", *categories).mapInArrow(lambda b: _counted(b, k), "word string, fold int, n long, hits array<double>")
    every = {"n": F.col("n")} | {f"c{j}": F.get("hits", F.lit(j)) for j in range(k)}
    by_word = keep(by_word.groupBy("word").agg(*(F.sum(x).alias(c) for c, x in every.items()), *(F.coalesce(F.sum(F.when(F.col("fold") == f, x)), F.lit(0)).alias(f"{c}{f}") for c, x in every.items() for f in range(o.folds))), "toxic-counts")
    of_fold = [_telling(by_word, n, hits, categories, o, f) for f in range(o.folds)]
    words = _telling(by_word, n, hits, categories, o, None)
    free(by_word)
    listed = tuple(dict.fromkeys([*words, *(w for own in of_fold for w in own)]))
    find = Lookup(listed)

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            own = [find.row(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.list_(pa.int64())), *batch.columns[3:]], ["h", "fold", "w", *categories])

    kinds = "h long, fold int, w array<long>" + "".join(f", `{c}` double" for c in categories)
    data = rows.select(F.xxhash64("id").alias("h"), "fold", "text", *categories).mapInArrow(numbered, kinds).orderBy("h").toPandas()
    free(sample)
    x = np.zeros((len(data), len(listed)))
    for i, own in enumerate(data["w"]):
        x[i, own] = 1.0
    return chain(x, data["fold"].to_numpy(np.int64), [data[c].to_numpy(float) for c in categories], words, [[listed.index(w) for w in own] for own in of_fold], categories, o)


def chain(x: np.ndarray, fold: np.ndarray, marks: list[np.ndarray], words: tuple[str, ...], of_fold: list[list[int]], categories: tuple[str, ...], o: Options) -> Model:
    """Rows by features (the model's own first), their folds, a row of marks for each category and each fold's features -> the chain. A category's
    out-of-fold probabilities become a feature of all later ones."""
    weights, earlier = [], np.zeros((len(x), 0))
    full = x[:, : len(words)]
    for y in marks:
        weights.append(logistic(np.concatenate([full, earlier], 1), y, o.ridge))
        out = np.zeros((len(x), 1))
        for f, own in enumerate(of_fold):
            if (fold == f).any():
                seen = np.concatenate([x[:, own], earlier], 1)
                w = logistic(seen[fold != f], y[fold != f], o.ridge)
                out[fold == f, 0] = 1 / (1 + np.exp(-np.clip(seen[fold == f] @ w[:-1] + w[-1], -30, 30)))
        earlier = np.concatenate([earlier, out], 1)
    return Model(words, categories, tuple(weights))


def tagged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with one column more, __chances: the categories' probabilities, in the chain's order. Null texts are empty; all rows stay."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shared.value.words)
        for batch in slices(batches, at):
            rows = [find.row(t) for t in batch.column(at).to_pylist()]
            p = shared.value.chances(rows)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*(f"c{i}" for i in range(batch.num_columns)), "p"])

    # columns travel under numbers, so that clashing names do no harm
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, kinds + ", p array<double>")
    return out.toDF(*docs.columns, "__chances")


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], o: Options = Options(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> key, p_<category> for each category, rejected (whether the last category's probability reaches the threshold); a row for each row.

    No labels or no documents: the probabilities are those of the labels' shares, one half without any.
    """
    model = fit(docs, labels, categories, o, key, text)
    rows = tagged(docs.select(key, text), model, text)
    p = [F.get("__chances", F.lit(j)) for j in range(len(categories))]
    return rows.select(key, *(x.alias(f"p_{c}") for x, c in zip(p, categories, strict=True)), (p[-1] >= o.threshold).alias("rejected"))


def clean(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], o: Options = Options(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that classify() does not reject, with all their columns."""
    rows = tagged(docs, fit(docs, labels, categories, o, key, text), text)
    return rows.filter(F.get("__chances", F.lit(len(categories) - 1)) < o.threshold).drop("__chances")
