"""Quantities, intervals and angles as expressions. Unknown is null, never 0; a division by zero is unknown too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.shapes import NUM, TO, groups, number, shape, tokens


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value made once: what f repeats is a name for it, not the expression, so nested functions stay small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def scalar(x: Column) -> Column:
    """One number, without a range: decimal, fraction, whole and fraction, whole and vulgar fraction."""
    return bind(tokens(x), lambda t: bind(F.regexp_extract(shape(t), f"^{NUM}$", 0), lambda z: number(t, F.lit(0), z)))


def _ends(x: Column) -> Column:
    """The two ends of a range, equal for a single number. Of a range of more than two numbers the first one is an end, and the other is the
    midpoint of the range that the rest makes, and so on."""
    chain = F.transform(F.split(x, r"(?iU)\s*(?:[-–—]|to)\s*", -1), scalar)
    tail = F.aggregate(F.reverse(F.slice(chain, F.lit(2), F.size(chain))), F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise((a + v) / 2))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def read(t: Column, z: Column) -> Column:
        one = lambda g: bind(number(t, F.lit(0), F.get(g, F.lit(0))), lambda v: pair(v, v))
        at = lambda g: F.length(F.get(g, F.lit(0))) + F.length(F.get(g, F.lit(1)))
        two = lambda g: pair(number(t, F.lit(0), F.get(g, F.lit(0))), number(t, at(g), F.get(g, F.lit(2))))
        found = bind(groups(z, rf"({NUM})(?:({TO})({NUM}))?$", 3), lambda g: F.when(F.get(g, F.lit(2)) == "", one(g)).when(g.isNotNull(), two(g)))
        return F.coalesce(found, F.when(z.rlike(f"^{NUM}(?:{TO}{NUM}){{2,}}$") & ~F.exists(chain, lambda v: v.isNull()), pair(F.get(chain, F.lit(0)), tail)))

    return bind(tokens(x), lambda t: bind(shape(t), lambda z: read(t, z)))


def bounds(x: Column) -> Column:
    """(lo, hi, value) of a number, or of a range in either order; the value of a range is its midpoint. `~` in front is dropped."""
    made = lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), F.struct(F.least(p["a"], p["b"]).alias("lo"), F.greatest(p["a"], p["b"]).alias("hi"), ((p["a"] + p["b"]) / 2).alias("value")))
    return bind(strip(F.regexp_replace(strip(x), r"^~\s*", "")), lambda x: bind(_ends(x), made))


def with_bounds(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with bounds() of a column as another one, in stages of one projection each, all of it compiled."""
    text = strip(F.regexp_replace(strip(F.col(x)), r"^~\s*", ""))
    df = df.withColumn("_x", text).withColumn("_t", tokens(F.col("_x"))).withColumn("_z", shape(F.col("_t"))).withColumn("_g", groups(F.col("_z"), rf"({NUM})(?:({TO})({NUM}))?$", 3))
    g = lambda i: F.get("_g", F.lit(i))
    a, b = number(F.col("_t"), F.lit(0), g(0)), number(F.col("_t"), F.length(g(0)) + F.length(g(1)), g(2))
    df = df.withColumn("_a", a).withColumn("_b", F.when(g(2) == "", F.col("_a")).otherwise(b))
    two = F.struct(F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi"), ((F.col("_a") + F.col("_b")) / 2).alias("value"))
    more = F.when(F.col("_g").isNull(), bounds(F.col("_x")))
    return df.withColumn(out, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), two).otherwise(more)).drop("_x", "_t", "_z", "_g", "_a", "_b")


def quantity(x: Column) -> Column:
    return bounds(x)["value"]


def plain(x: Column, decimals: int = 3) -> Column:
    """A number as text: whole ones bare, others with so many decimals at most and no zeros behind."""
    return F.replace(F.call_function("format_number", x, F.lit("0." + "#" * decimals)), F.lit(","), F.lit(""))


def quantity_text(x: Column) -> Column:
    """A quantity written as a number; `~` stays, and so does what is no quantity."""
    tilde = F.when(strip(x).startswith("~"), F.lit("~")).otherwise(F.lit(""))
    return F.coalesce(F.concat(tilde, plain(quantity(x))), x)


def interval_gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """0 where two intervals meet, else the gap between them over the larger upper bound."""
    gap = F.greatest(lo_a - hi_b, lo_b - hi_a, F.lit(0.0))
    return F.when(gap <= 0, F.lit(0.0)).otherwise(F.try_divide(gap, F.greatest(hi_a, hi_b)))


def interval_text(lo: Column, hi: Column) -> Column:
    one = lambda x: F.replace(F.call_function("format_number", x, F.lit("0.0")), F.lit(","), F.lit(""))
    return F.when(hi - lo < 0.05, F.concat(one(lo), F.lit("g"))).otherwise(F.concat(one(lo), F.lit("-"), one(hi), F.lit("g")))


def relative_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def celsius(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def separation(ra_a: Column, dec_a: Column, ra_b: Column, dec_b: Column) -> Column:
    """Degrees between two near places on the sky."""
    d = F.pmod(ra_a - ra_b + 180.0, F.lit(360.0)) - 180.0
    return F.hypot(d * F.cos(F.radians((dec_a + dec_b) / 2)), dec_a - dec_b)
