"""Sources and sinks: corpora of text files, frontmatter, dimension files, fixed-length records, JSON features."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tamis.functions.dims import DENSITIES
from tamis.functions.workers import importable

FRONT = r"(?s)^\s*-{3,}[ \t]*\r?\n(.*?)\r?\n-{3,}[ \t]*(?:\r?\n(.*))?$"


#: The most rows that a dimension file may have: its values become literals of expressions.
DIMENSION = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def corpus(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Markdown files below the folders -> file, text; without index.md and byte order marks. Folders that are not there are left out."""
    folders = [f for f in folders if exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], "file string, text string")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").text(folders, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("text"))
    return rows.filter(~F.col("file").rlike(r"(?:^|/)index\.md$"))


@F.pandas_udf(StringType())
def _yaml_json(texts: pd.Series) -> pd.Series:
    import json

    import yaml

    def one(t):
        try:
            out = yaml.safe_load(t) if t else None
            return json.dumps(out, default=str, ensure_ascii=False) if isinstance(out, dict) else None
        except yaml.YAMLError:
            return None

    return texts.map(one)


def frontmatter(docs: DataFrame) -> DataFrame:
    """docs (.., text) -> with metadata (JSON text of the frontmatter, null without) and body. Unclosed frontmatter is body."""
    has = F.col("text").rlike(FRONT)
    docs = docs.withColumn("metadata", F.when(has, _yaml_json(F.regexp_extract("text", FRONT, 1))))
    return docs.withColumn("body", F.when(has, F.regexp_extract("text", FRONT, 2)).otherwise(F.col("text")))


def densities(spark: SparkSession, path: str | None) -> list[tuple[str, float]]:
    """(pattern, density) of a CSV file, a dimension of DIMENSION rows at most; rows without a number are left out, of repeated patterns the last
    counts. Without a file, or where it lacks one of the two columns, the defaults."""
    rows = spark.read.option("header", True).csv(path) if path is not None and exists(spark, path) else None
    if rows is None or not {"pattern", "density"} <= set(rows.columns):
        return list(DENSITIES)
    found = rows.select(F.trim("pattern").alias("p"), F.trim("density").try_cast("double").alias("d")).filter("d IS NOT NULL").take(DIMENSION + 1)
    if len(found) > DIMENSION:
        raise ValueError(f"{path} has over {DIMENSION} rows: too many for literals")
    return list({r.p: r.d for r in found}.items())


def star_records(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of a header, seven little-endian integers with minus the number of records third and their size last, and records of float id,
    double ra and dec in radians, two letters of class and an integer of hundredths of magnitude -> ord, ra, dec in degrees, class, mag. A file that is
    not as long as its header says is an error."""
    columns = [("id", "<f4"), ("ra", "<f8"), ("dec", "<f8"), ("class", "S2"), ("mag", "<i2")]

    def decode(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for raw in part["content"]:
                head = np.frombuffer(raw, "<i4", 7) if len(raw) >= 28 else np.zeros(7, int)
                n, size = abs(int(head[2])), int(head[6])
                if len(raw) < 28 or size < 24 or 28 + n * size != len(raw):
                    raise ValueError("the catalogue is not as long as its header says")
                kind = np.dtype({"names": [c for c, _ in columns], "formats": [t for _, t in columns], "offsets": [0, 4, 12, 20, 22], "itemsize": size})
                at = np.frombuffer(raw, kind, n, 28)
                yield pd.DataFrame({"ord": np.arange(n), "ra": np.degrees(at["ra"]) % 360, "dec": np.degrees(at["dec"]), "class": np.char.decode(at["class"], "latin1"), "mag": at["mag"] / 100})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "ord long, ra double, dec double, class string, mag double")


def features(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON collection -> id, and points of each line: line, pos, ra, dec."""
    kind = "features array<struct<id:string,geometry:struct<coordinates:array<array<array<double>>>>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rows = rows.select("f.id", F.posexplode("f.geometry.coordinates").alias("line", "points")).select("id", "line", F.posexplode("points").alias("pos", "p"))
    return rows.select("id", "line", "pos", F.pmod(F.get("p", F.lit(0)), F.lit(360.0)).alias("ra"), F.get("p", F.lit(1)).alias("dec"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row, nulls kept, to a new path."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


#: Folder below the root where files are written before they get their names.
STAGING = "_staging-"


def _opened(root: str):
    """The file system of a root and the root's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


def write_files(rows: DataFrame, root: str, only: Column | None = None, counters: dict[str, Column] | None = None) -> dict[str, int]:
    """rows (path, text, any others) -> one file a row below `root`, a folder that driver and executors share, UTF-8 and without anything added; the number of
    files, as `written`, and the counters, aggregates of all rows that are observed in the pass that writes. only: which rows are written.

    Every task writes to a staging folder of its own attempt and gives a file its name only when it is whole, so a task that fails leaves no half file
    and one that runs again, or twice at once, ends with the same files. Files of other names stay. Of what is to be written paths that are null,
    absolute, hold `..` or occur twice, and null texts, are errors before anything is written. No rows write nothing, and all counters are 0.
    """
    importable(rows.sparkSession)
    only, counters = F.lit(True) if only is None else only, counters or {}
    if rows.isEmpty():
        return {"written": 0} | dict.fromkeys(counters, 0)
    bad = F.col("path").isNull() | F.col("text").isNull() | F.coalesce(F.col("path").rlike(r"^/|^$|(^|/)\.\.?(/|$)|/$"), F.lit(False))
    wrong = rows.filter(only).groupBy("path").agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad")).filter("bad OR n > 1").first()
    if wrong is not None:
        raise ValueError(f"{wrong.path!r} is no path of one file with a text")
    job, root = uuid.uuid4().hex, root.rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(root)
        context, done = TaskContext.get(), 0
        stage = f"{base}/{STAGING}{job}/{context.taskAttemptId() if context else 0}"
        store.create_dir(stage, recursive=True)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{stage}/{done}") as out:
                    out.write(text.encode())
                target = f"{base}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                store.move(f"{stage}/{done}", target)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    seen = Observation("written rows")
    observed = rows.observe(seen, *(c.alias(k) for k, c in counters.items())) if counters else rows
    try:
        n = observed.filter(only).select("path", "text").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return {"written": n} | (dict(seen.get) if counters else {})
    finally:
        where = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{root}/{STAGING}{job}")
        where.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def write_json_files(rows: DataFrame, root: str, path: str = "file") -> int:
    """rows (path, any others) -> one indented JSON file a row below `root`, at its path with the suffix json: nulls and text beyond ASCII kept."""
    document = F.to_json(F.struct(*(c for c in rows.columns)), {"ignoreNullFields": "false", "pretty": "true"})
    named = F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".json"))
    return write_files(rows.select(named.alias("path"), document.alias("text")), root)["written"]


# Names that belong to no site, though they are in its folder.
EXCLUDED = ("sw.js", "sitemap.xml", "robots.txt", "feed.xml")


def listing(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """The files below a folder -> path (relative to it), length, modified; by path. No content is read. Names in `excluded` are left out; a folder that
    is not there or is empty gives no rows. Rows are ordered by path, as consumers that number or digest them need it."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, length long, modified timestamp")
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    full = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rows = rows.select(F.substr(full, F.lit(len(base) + 2)).alias("path"), "length", "modified")
    return rows.filter(~F.element_at(F.split("path", "/"), -1).isin(*excluded)).orderBy("path")


def digests(docs: DataFrame) -> DataFrame:
    """docs (file, text) -> file, sha (hex of the text's SHA-256; of a null text null)."""
    return docs.select("file", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def staleness(now: DataFrame, kept: DataFrame) -> DataFrame:
    """Two manifests (file, sha) -> file, state of what differs: new, stale (other content) or gone, as seen from `now`. Files whose digests agree, nulls too, are
    left out, so no rows mean that what is kept is current. A file that a manifest repeats counts by its least digest."""
    one = lambda df, name: df.groupBy("file").agg(F.min("sha").alias(name), F.lit(True).alias(f"in_{name}"))
    both = one(now, "a").withColumnRenamed("file", "file_a").join(one(kept, "b").withColumnRenamed("file", "file_b"), F.col("file_a").eqNullSafe(F.col("file_b")), "full")
    state = F.when(F.col("in_b").isNull(), "new").when(F.col("in_a").isNull(), "gone").when(~F.col("a").eqNullSafe(F.col("b")), "stale")
    return both.select(F.coalesce("file_a", "file_b").alias("file"), state.alias("state")).filter("state IS NOT NULL")


def rendered(template: str, values: dict[str, Column], rows: DataFrame, out: str = "text") -> DataFrame:
    """rows with a template filled in: every placeholder of `values` has to be there, and none, written `__LIKE_THIS__`, may be left; else it is an error."""
    missing = [k for k in values if k not in template]
    if missing:
        raise ValueError(f"the template lacks {', '.join(missing)}")
    # the values go in between the pieces of the template, so what looks like a placeholder inside a value is not one
    pieces = re.split("(" + "|".join(map(re.escape, values)) + ")", template) if values else [template]
    left = [m for p in pieces[::2] for m in re.findall(r"__[A-Z][A-Z_]*__", p)]
    if left:
        raise ValueError(f"nothing fills {', '.join(left)}")
    return rows.withColumn(out, F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces))))
