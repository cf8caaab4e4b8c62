"""Catalogues, manifests and nearest neighbours on the sky."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.functions.numbers import separation

# Suffixes of a site's shell, and of sources that should not be published.
SHELL = ("css", "js", "json", "svg", "png", "ico", "woff2", "webmanifest", "txt")
SOURCES = ("py", "pyc", "rb")
LIMIT = 2 * 1024 * 1024
# The bucket of each class letter; others are A.
BUCKETS = {"O": "O", "W": "O", "B": "B", "A": "A", "F": "F", "G": "G", "K": "K", "M": "M", "C": "M", "S": "M", "N": "M", "R": "M"}


def snapped(points: DataFrame, stars: DataFrame, most: float = 0.05) -> DataFrame:
    """points (point, ra, dec) -> point, star, sep: the nearest of stars (star, ra, dec), ties to the smaller one, where it is within `most` degrees.

    Points and stars are taken by place, so places that many of them share meet once. Places meet by an equi-join on bands of declination, `most` high, and cells of
    right ascension in them, wide enough for their latitude: a star stands in its band and both neighbours, a point looks into its own
    cell and both neighbours, around 360. So a point costs as many pairs as there are different places of stars near it.
    """
    place = ["ra", "dec"]
    own = stars.groupBy(F.col("ra").alias("sra"), F.col("dec").alias("sdec")).agg(F.min("star").alias("star"))
    high = most * (1 + 1e-9)  # a hair more, for what division rounds
    band = lambda dec: F.floor(dec / high).cast("int")
    # how many cells go around a band: none is narrower than what `most` spans at its latitude
    edge = F.greatest(F.abs(F.col("band")), F.abs(F.col("band") + 1)) * high + high
    around = F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), edge))) / high)).cast("int")
    cell = lambda ra: F.least(F.floor(F.pmod(ra, F.lit(360.0)) * F.col("n") / 360).cast("int"), F.col("n") - 1)
    s = own.withColumn("band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: band(F.col("sdec")) + d))).withColumn("n", around).withColumn("cell", cell(F.col("sra")))
    p = points.select(*place).distinct().withColumn("band", band(F.col("dec"))).withColumn("n", around)
    p = p.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("ra")) + d, F.col("n")))))).drop("n")
    near = p.join(s.drop("n"), ["band", "cell"]).withColumn("sep", separation(F.col("ra"), F.col("dec"), F.col("sra"), F.col("sdec")))
    best = near.filter(F.col("sep") <= most).groupBy(*place).agg(F.min(F.struct("sep", "star")).alias("b"))
    best = points.join(best, place).groupBy("point").agg(F.min("b").alias("b"))
    return best.select("point", F.col("b.star").alias("star"), F.col("b.sep").alias("sep"))


def asset_kind(path: Column, length: Column) -> Column:
    """page, shell, source or null of a file of a built site."""
    name = F.lower(F.regexp_extract(path, r"\.([^./?#]+)$", 1))
    return F.when(name.isin(*SOURCES), "source").when(length > LIMIT, F.lit(None)).when(name == "html", "page").when(name.isin(*SHELL), "shell")


def build_id(files: DataFrame) -> DataFrame:
    """files (path, sha: hex of the content's SHA-256) -> build_id: 16 hex digits of the SHA-256 over all paths and digests in order of path.

    One value of a whole site: its paths and digests, not its files, meet in one row, as the definition asks.
    """
    pairs = files.agg(F.array_sort(F.collect_list(F.struct("path", "sha"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda f: F.concat(F.hex(f["path"]), F.lit("00"), f["sha"])), "")
    return pairs.select(F.substring(F.sha2(F.unhex(joined), 256), 1, 16).alias("build_id"))


def visible(stars: DataFrame) -> DataFrame:
    """Without blank entries and those fainter than 6.5."""
    return stars.filter(~((F.col("mag") == 0) & (F.col("ra") == 0)) & (F.col("mag") <= 6.5))


def class_bucket(kind: Column) -> Column:
    """The bucket of a class by its first letter; A for any other, and for none."""
    letter = F.upper(F.left(F.trim(kind), F.lit(1)))
    found = F.lit("A")
    for bucket in sorted(set(BUCKETS.values())):
        found = F.when(letter.isin(*(k for k, v in BUCKETS.items() if v == bucket)), bucket).otherwise(found)
    return F.coalesce(found, F.lit("A"))


def quantised(value: Column, scale: float, shift: float = 0.0) -> Column:
    return F.rint((value + shift) * scale).cast("long")


def lower_median(values: Column) -> Column:
    """Element n // 2 of the sorted values; not interpolated."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows -> by, median (as lower_median(), nulls left out, null for a group without values) and worst. Rows are counted by value first, so a hot
    group costs as many rows as it has different values."""
    counts = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    w = W.partitionBy(*by)
    counts = counts.withColumn("_all", F.sum("_n").over(w)).withColumn("_upto", F.sum("_n").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    half = F.floor(F.col("_all") / 2)
    return counts.groupBy(*by).agg(F.min(F.when(F.col("_upto") > half, F.col("_v"))).alias("median"), F.max("_v").alias("worst"))
