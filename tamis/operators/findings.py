"""Rule-based findings and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.numbers import celsius, interval_gap
from tamis.operators.units import looked_up, representation_bounds
from tamis.operators.windows import first_wins

SEVERITIES = ("error", "warning", "info")
MASS_TOLERANCE, DEGREES = 0.10, 5.0


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i))), severity)


def mass_conflict(a: Column, b: Column, pieces: Column | None = None, per_unit: Column | None = None) -> Column:
    """The relative gap of two gram intervals (struct lo, hi) where it is over the tolerance. The second one is scaled by the number of pieces
    where it holds for each, or where only then it agrees."""
    plain = interval_gap(a["lo"], a["hi"], b["lo"], b["hi"])
    if pieces is None:
        return F.when(plain > MASS_TOLERANCE, plain)
    scaled = interval_gap(a["lo"], a["hi"], b["lo"] * pieces, b["hi"] * pieces)
    gap = F.when(per_unit, scaled).when((plain > 0) & (scaled == 0), scaled).otherwise(plain)
    return F.when(gap > MASS_TOLERANCE, gap)


def mass_conflicts(items: DataFrame) -> DataFrame:
    """Parsed items whose first alternative is farther from the amounts than the tolerance, with the gap. The alternative is
    scaled by the pieces of the amounts where it is for each, or where only then both overlap."""
    rows = items.withColumn("_alt", F.get("alternatives", F.lit(0))).withColumn("_k", F.when(F.col("_alt").isNotNull(), looked_up(F.col("name"))))
    rows = rows.withColumn("_a", F.when(F.col("_alt").isNotNull(), representation_bounds(F.col("amounts"), F.col("_k")))).withColumn("_b", F.when(F.col("_alt").isNotNull(), representation_bounds(F.col("_alt.terms"), F.col("_k"))))
    rows = rows.withColumn("_n", F.aggregate(F.filter("amounts", lambda t: t["unit_class"] == "piece"), F.lit(0.0), lambda a, t: a + t["value"]))
    many = F.col("_n") > 1
    gap = F.when(many, mass_conflict(F.col("_a"), F.col("_b"), F.col("_n"), F.col("_alt.per_unit"))).otherwise(mass_conflict(F.col("_a"), F.col("_b")))
    # only conflicts make rows; a filter would be pushed down, and copy the stages it passes
    return rows.withColumn("gap", F.explode(F.array_compact(F.array(gap)))).drop("_alt", "_k", "_a", "_b", "_n")


def temperature_conflict(found: Column) -> Column:
    """Degrees Celsius between the first two temperatures of a step, where their scales differ and it is over the tolerance."""
    a, b = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    number = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("double")
    c = lambda x: F.when(x.endswith("F"), celsius(number(x))).otherwise(number(x))
    gap = F.abs(c(a) - c(b))
    return F.when((F.right(a, F.lit(1)) != F.right(b, F.lit(1))) & (gap > DEGREES), gap)


def unmatched_components(rows: DataFrame, *more: str) -> DataFrame:
    """(file, rec, section, component) -> components of ingredients without directions, with more columns that a record has one value of; `main` and `default` don't count."""
    key = F.lower(F.trim("component"))
    rows = rows.withColumn("key", key).filter(~F.col("key").isin("main", "default"))
    have = rows.filter("section = 'ingredients'").groupBy("file", "rec", *more, "key").agg(F.min("component").alias("component"))
    return have.join(rows.filter("section = 'directions'").select("file", "rec", "key").hint("merge"), ["file", "rec", "key"], "left_anti").select("file", "rec", *more, "component")


def missing_sections(rows: DataFrame, *more: str) -> DataFrame:
    """routed lines -> file, rec, more columns that a record has one value of, code of records without headings or sections."""
    two = (F.col("kind") == "heading") & (F.col("level") == 2)
    by = rows.groupBy("file", "rec", *more).agg(F.bool_or(two).alias("two"), F.bool_or(two & (F.col("section") == "ingredients")).alias("ingredients"), F.bool_or(two & (F.col("section") == "directions")).alias("directions"), F.bool_or(F.col("kind") == "item").alias("list"), F.bool_or(F.col("kind").isin("item", "text")).alias("content"))
    codes = F.array_compact(F.array(F.when(~F.col("two") & F.col("content"), "no-section-headings"), F.when(F.col("two") & F.col("list") & ~F.col("ingredients"), "missing-ingredients-section"), F.when(F.col("two") & F.col("list") & ~F.col("directions"), "missing-directions-section")))
    return by.select("file", "rec", *more, F.explode(codes).alias("code"))


def deduplicated(findings: DataFrame) -> DataFrame:
    """The first finding of each file, code, title, message and context; the line is not part of the key."""
    return first_wins(findings, ["file", "code", "title", "message", "context"], [F.col("emit_ord")])


def by_severity(findings: DataFrame) -> DataFrame:
    """All severities with their counts, 0 included."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def shown(findings: DataFrame, codes: list[str] | None = None, errors_only: bool = False, verbose: bool = False) -> DataFrame:
    """What a report shows, most severe first: by code if asked for, then errors alone or all but what only informs."""
    out = findings.filter(F.col("code").isin(codes)) if codes else findings
    out = out.filter("severity = 'error'") if errors_only else out if verbose else out.filter("severity <> 'info'")
    return out.orderBy(severity_rank(F.col("severity")), "code", F.coalesce("line", F.lit(0)))


def rendered(severity: Column, code: Column, message: Column, detail: Column, most: int = 12) -> Column:
    """A finding as text; of its details the first ones, and how many more there are."""
    first = F.slice(detail, 1, most)
    more = F.when(F.size(detail) > most, F.array(F.concat(F.lit("... and "), F.size(detail) - most, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("\n", F.concat(F.lit("["), F.upper(severity), F.lit("] "), code, F.lit(": "), message), F.array_join(F.transform(F.concat(first, more), lambda d: F.concat(F.lit("  - "), d)), "\n"))
