"""What the operators of this package share: words, tables, and results kept in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none where it is null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets a new one, as in tests; on a cluster, whose machines would
    each write to a folder of their own, it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: results between stages need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tamis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone by then
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts its lineage, so that it is made once and lost executors
    cost no earlier stage. The files go by free(), or else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def free(*frames: DataFrame) -> None:
    """Deletes the files of kept frames whose last reader has run."""
    for df in frames:
        _remove(df.sparkSession, df.kept_path)


#: What Python workers get: memory that is given back is returned to the system, and not held for later by worker after worker.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_MMAP_THRESHOLD_": "1048576"}
#: Bytes of a batch that goes to a Python worker, a longer row aside.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it, and bounds their memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
        for name, value in WORKER.items():
            env.setdefault(name, value)
    spark.conf.set(BATCH, str(4 << 20))


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the texts of each piece hold about `most` bytes, or one row holds more."""
    for batch in batches:
        col = batch.column(text)
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """(h) -> a bitmap of 2**bits bits, one set for the first bits of each 64-bit hash, as words of 64. An aggregate makes the words, so what
    reaches the driver is no larger than the bitmap, whatever the number of hashes."""
    at = hashes.select(F.expr(f"shiftrightunsigned(h, {64 - bits})").alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return out.view(np.uint64)
