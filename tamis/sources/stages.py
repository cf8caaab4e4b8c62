"""Results between stages, written once to the folder that all executors share and read again: plans start anew there, and lost executors cost no earlier stage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets a new one; on a cluster, whose machines would each write to their own, it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
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


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet; its files go by release(), or else when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


#: Rows of texts that a task parses.
ROWS = 8192


def parts(df: DataFrame, rows: int = ROWS) -> int:
    """How many tasks the rows of df make. Small files hold many rows, and each may become many lines, so bytes read tell too little; one pass counts them."""
    return max(1, -(-df.count() // rows))


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """df dealt over n tasks, by columns or evenly; as it is where one will do."""
    return df.repartition(n, *by) if n > 1 else df


def release(*frames: DataFrame) -> None:
    """Deletes the files of kept frames whose last reader has run."""
    for df in frames:
        _remove(df.sparkSession, df.kept_path)
