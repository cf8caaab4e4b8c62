"""Embedding whitening by a two-pass covariance.

Entries become integers, so the first pass sums them exactly and the mean is one rational number a dimension, whatever the order of rows. The second
pass centres every vector and adds up outer products, a matrix product a batch; one matrix a partition is merged by treeAggregate. The driver, which
holds no more than matrices of the vectors' dimension, takes eigenvalues and eigenvectors from LAPACK, and tasks project with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import keep, ship

SCALE, SHIFT = 64, 1_000_000
#: Rows of a matrix product.
ROWS = 4096


def finite(v: Column) -> Column:
    """Whether a vector is not null and holds no null or non-finite entry."""
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def fixed(v: Column) -> Column:
    """Entries as integers; those beyond 62 bits end there."""
    most = F.lit(2.0**62)
    return F.transform(v.cast("array<double>"), lambda c: F.floor(F.greatest(-most, F.least(most, c * F.lit(float(SCALE))))) + F.lit(SHIFT))


def _blocks(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns, in 64 bits where they are sure to fit."""
    small = max(abs(int(x.max())), abs(int(x.min()))) < (1 << 62) // len(x)
    return [int(s) for s in (x if small else x.astype(object)).sum(0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they are sure to fit, else Python's."""
    small = max(abs(int(x.max())), abs(int(x.min()))) < (1 << 62) // n and max(map(abs, sums)) < 1 << 62
    return x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares of rows; null where 64 bits do not hold one."""
    about = (d.astype(float) ** 2).sum(1)
    if d.dtype != object and about.max(initial=0) < 2.0**62:
        return (d * d).sum(1).tolist()
    exact = ((int(i), sum(int(v) ** 2 for v in d[i])) for i in np.flatnonzero(about < 2.0**64))
    fits = {i: s for i, s in exact if s < 1 << 63}
    return [fits.get(i) for i in range(len(d))]


def tree_sum(fit: DataFrame, dim: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all fitted vectors of `of` a block of them, (rows, dim) -> (rows, width), taken as outer products: (width, width)."""

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _blocks(batches, 0):
            y = of(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    add = lambda a, b: a + b
    return fit.select("x").mapInArrow(products, "m binary").rdd.treeAggregate(np.zeros((width, width)), lambda a, r: a + np.frombuffer(bytes(r.m)).reshape(width, width), add, depth=2)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """vectors (key, vector, any others) -> a row per vector and component: key, component (from 1, by falling eigenvalue), n (distinct fitted vectors),
    deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries take no part; rows with a null key, and all rows that repeat a key or vector, have
    results of their own, while the fit takes each distinct vector once. Empty vectors take no part, nor do vectors of another length than most rows have
    (of equally frequent lengths the longest). Directions without variance have no component, so equal vectors only, or no rows, give none.
    A deviation beyond 64 bits is null. Other columns are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(finite(F.col("v")) & (F.size("v") > 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length.d
    rows = rows.filter(F.size("v") == dim).select("id", fixed(F.col("v")).alias("x"))
    fit = keep(rows.select("x").distinct(), "whitening-fit")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch, x in _blocks(batches, 0):
            total, n = [a + b for a, b in zip(total, exact_sums(x), strict=True)], n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in total]], pa.list_(pa.string()))], ["n", "s"])

    parts = keep(fit.mapInArrow(sums, "n long, s array<string>"), "whitening-sums")
    n = parts.agg(F.sum("n")).first()[0]
    by_dimension = parts.select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = [int(r.s) for r in by_dimension.orderBy("i").collect()]
    mean = spark.sparkContext.broadcast((n, total))

    def centre(x: np.ndarray) -> np.ndarray:
        n, total = mean.value
        return (centred(x, n, total) / n).astype(float)

    covariance = tree_sum(fit, dim, dim, centre) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:components] > max(values[0], 0.0) * dim * np.finfo(float).eps).sum())
    if not k:
        return spark.createDataFrame([], schema)
    explained = values[:k] / np.trace(covariance)
    project = spark.sparkContext.broadcast(axes[:, :k] / np.sqrt(values[:k]))
    error = float(np.abs(tree_sum(fit, dim, k, lambda x: centre(x) @ project.value) / n - np.eye(k)).max())

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = mean.value
        for batch, x in _blocks(batches, 1):
            d, m = centred(x, n, total), batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(d), pa.int64()).take(each)]
                + [pa.array(((d / n).astype(float) @ project.value).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names
            )

    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.select("id", "x").mapInArrow(projected, schema)
