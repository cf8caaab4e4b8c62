"""Units and weights: lookups in literal tables, most-specific patterns, and grams as intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.dims import ALIASES, DENSITIES, FACTORS, OPAQUE, PIECES
from tamis.functions.numbers import bind
from tamis.functions.shapes import literal_map


def unit_of(word: Column) -> Column:
    """A spelling of a unit, in any case and with or without a point -> struct unit, unit_class; null if it is none. No join, no shuffle."""
    table = literal_map({a: f"named_struct('unit', '{u}', 'unit_class', '{k}')" for a, (u, k) in ALIASES.items()})
    return table[F.lower(F.rtrim(word, F.lit(".")))]


def name_key(name: Column) -> Column:
    return F.translate(F.lower(name), " -/", "___")


def best_pattern(key: Column, patterns: list[tuple]) -> Column:
    """The most specific of (pattern, values...) for a key: exact before glob, then more literal characters, then the longer pattern, then the
    first. A pattern also matches inside the key. -> struct of the values, v0, v1 ...; null if none matches."""
    def ranked(key: Column) -> Column:
        found = []
        for i, (pattern, *values) in enumerate(patterns):
            literal = pattern.strip("*")
            hit = key.rlike(".*".join(re.escape(p) for p in literal.split("*"))) if "*" in literal else F.contains(key, F.lit(literal))
            rank = F.struct((key == pattern).cast("int").alias("exact"), F.lit(len(pattern.replace("*", ""))).alias("literal"), F.lit(len(pattern)).alias("length"), F.lit(-i).alias("first"), F.struct(*(F.lit(v).alias(f"v{j}") for j, v in enumerate(values))).alias("values"))
            found.append(F.when(hit, rank))
        return F.array_max(F.array(*found))["values"]

    return bind(key, ranked)


def looked_up(name: Column, densities: list[tuple] = DENSITIES) -> Column:
    """What the weight tables know of a name: struct piece (least and most grams of one, or null) and density. To be made once a row."""
    return bind(name_key(name), lambda key: F.struct(best_pattern(key, PIECES).alias("piece"), F.coalesce(best_pattern(key, densities)["v0"], F.lit(1.0)).alias("density")))


def weighed(value: Column, unit: Column, unit_class: Column, known: Column) -> Column:
    """A measured amount -> struct lo, value, hi in grams by looked_up() values; null where its mass is unknown."""
    table = literal_map({k: f"{v!r}D" for k, v in FACTORS.items()})
    triple = lambda lo, v, hi: F.struct(lo.cast("double").alias("lo"), v.cast("double").alias("value"), hi.cast("double").alias("hi"))
    same = lambda v: F.when(v.isNotNull(), triple(v, v, v))
    p, factor = known["piece"], F.coalesce(table[unit], F.lit(1.0))
    counted = F.when(p.isNotNull() & ~unit.isin(*OPAQUE), triple(value * p["v0"], value * ((p["v0"] + p["v1"]) / 2), value * p["v1"]))
    out = F.when(unit_class == "piece", counted).when(unit_class == "weight", same(value * factor)).when(unit_class == "volume", same(value * factor * known["density"]))
    return out.when(unit_class == "length", F.lit(None)).when(unit_class.isNotNull(), same(F.lit(0.0)))


def whole(value: Column, unit: Column, unit_class: Column, inner: Column) -> Column:
    """An amount of containers as the amount of what they hold. Amounts are multiplied before units are applied, so that the product is rounded once."""
    nested = (unit_class == "piece") & inner["value"].isNotNull() & (inner["unit_class"] != "length")
    pick = lambda a, b: F.when(nested, a).otherwise(b)
    return F.struct(pick(value * inner["value"], value).alias("value"), pick(inner["unit"], unit).alias("unit"), pick(inner["unit_class"], unit_class).alias("unit_class"))


def grams(value: Column, unit: Column, unit_class: Column, name: Column, inner: Column | None = None, densities: list[tuple] = DENSITIES) -> Column:
    """A measured amount of a named thing -> struct lo, value, hi in grams; null where its mass is unknown. inner: what one container holds, a struct
    with value, unit and unit_class, null where it says nothing; then a count of containers weighs that many of it."""
    known = looked_up(name, densities)
    if inner is None:
        return bind(known, lambda k: weighed(value, unit, unit_class, k))
    return bind(F.struct(known.alias("k"), whole(value, unit, unit_class, inner).alias("m")), lambda x: weighed(x["m"]["value"], x["m"]["unit"], x["m"]["unit_class"], x["k"]))


def weight_details(value: Column, unit: Column, unit_class: Column, name: Column, densities: list[tuple] = DENSITIES) -> Column:
    """A measured amount of a named thing, not nested -> struct value, value_min, value_max (grams; the last two of pieces only), unit and details: by which factor, density
    or weight of a piece it was made, or why its mass is unknown."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    table = literal_map({k: f"{v!r}D" for k, v in FACTORS.items()})
    bare = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")

    def told(x: Column) -> Column:
        key, p, d = x["key"], x["piece"], x["density"]
        factor = F.coalesce(table[unit], F.lit(1.0))
        out = lambda v, text, lo=None, hi=None: F.struct(v.cast("double").alias("value"), (F.lit(None) if lo is None else lo).cast("double").alias("value_min"), (F.lit(None) if hi is None else hi).cast("double").alias("value_max"), unit.alias("unit"), text.alias("details"))
        none, density = F.lit(None), F.coalesce(d["v1"], F.lit(1.0))
        pieces = (
            F.when(unit.isin(*OPAQUE), out(none, say("'", unit, "' is a container unit; its weight depends on the contents (unknown)"))).when(p.isNull(), out(none, say("No piece weight known for '", key, "' (unknown, not zero)")))
            .otherwise(out(value * (p["v1"] + p["v2"]) / 2, say("Piece weight for pattern '", p["v0"], "': ", bare(p["v1"]), "-", bare(p["v2"]), "g each"), value * p["v1"], value * p["v2"]))
        )
        return (
            F.when(unit_class == "piece", pieces).when(unit_class == "weight", out(value * factor, say("Weight conversion factor: ", factor.cast("string"), "g/", unit)))
            .when(unit_class == "volume", out(value * factor * density, say("Volume conversion factor: ", factor.cast("string"), "ml/", unit, ", Density for pattern '", F.coalesce(d["v0"], F.lit("water (default)")), "': ", density.cast("string"), "g/ml")))
            .when(unit_class == "length", out(none, say("'", unit, "' measures a length; mass per unit length is ingredient-specific (unknown, not zero)"))).otherwise(out(F.lit(0.0), F.lit("Unknown unit class")))
        )

    own = [(p, p, *v) for p, *v in PIECES], [(p, p, *v) for p, *v in densities]
    return bind(bind(name_key(name), lambda k: F.struct(k.alias("key"), best_pattern(k, own[0]).alias("piece"), best_pattern(k, own[1]).alias("density"))), told)


def with_grams(df: DataFrame, term: str, name: str, out: str, densities: list[tuple] = DENSITIES) -> DataFrame:
    """df with the weight of a term of the item grammar as a column struct lo, value, hi more, in compiled stages."""
    df = df.withColumn("_k", name_key(F.col(name))).withColumn("_piece", best_pattern(F.col("_k"), PIECES)).withColumn("_density", F.coalesce(best_pattern(F.col("_k"), densities)["v0"], F.lit(1.0)))
    t = F.col(term)
    df = df.withColumn("_m", whole(t["value"], t["unit"], t["unit_class"], t["nested"]))
    known = F.struct(F.col("_piece").alias("piece"), F.col("_density").alias("density"))
    return df.withColumn(out, weighed(F.col("_m.value"), F.col("_m.unit"), F.col("_m.unit_class"), known)).drop("_k", "_piece", "_density", "_m")


def representation_bounds(terms: Column, known: Column) -> Column:
    """The least and most grams of a sum of terms: struct lo, hi over those whose mass is known; null if there is none, or no mass."""

    def ends(t: Column) -> Column:
        at = lambda v: bind(whole(t[v], t["unit"], t["unit_class"], t["nested"]), lambda m: weighed(m["value"], m["unit"], m["unit_class"], known))
        return F.struct(at("lo")["lo"].alias("lo"), at("hi")["hi"].alias("hi"))

    counted = F.filter(F.transform(terms, ends), lambda e: e["lo"].isNotNull() & (e["hi"] > 0))
    total = lambda c: lambda xs: F.aggregate(F.transform(xs, lambda e: e[c]), F.lit(0.0), lambda a, x: a + x)
    return bind(counted, lambda xs: F.when(F.size(xs) > 0, F.struct(total("lo")(xs).alias("lo"), total("hi")(xs).alias("hi"))))


def with_best_pattern(df: DataFrame, name: str, patterns: list[tuple], out: str) -> DataFrame:
    """df with a column more, for many patterns and repeated names: the lookup runs once for each distinct name and is joined back, so that
    regular expressions cost as the names, not the rows. A name that a third of the rows share is one row of the small side; Spark splits
    the large side or broadcasts the small one, as measured."""
    names = df.select(F.col(name).alias("__name")).distinct().withColumn(out, best_pattern(name_key(F.col("__name")), patterns))
    return df.join(names, df[name].eqNullSafe(names["__name"]), "left").drop("__name")
