"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Within a source the documents stand in one fixed order, every document is expected `target / source_size` times, the expected copies
are summed up along the order, one random offset is added, and a document is emitted once per integer that its interval crosses.
Since the order goes by size, the words taken differ from the target by no more than about the largest document.

The running sum is a multiple of a document's rank, so the job is one distributed rank: counts per size class, per size and per part of
the hash are summed in three small steps, and only rows that share source, size and three hex digits of their hash meet in a task. A
source that holds a third of all rows, or a third of all rows with one size, so spreads over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.llm.common import keep


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size), a row for each source -> with target: budget * all sizes shared by weight, no source above
    `most` times its size, the excess shared again by weight. Weights repeat along the sources by code point, null last.

    The end of the resharing in closed form: by cap per weight, the first sources are held at their caps and the others share the rest.
    """
    cap, w = F.col("source_size") * F.lit(float(most)), F.col("w")
    by_name, by_ratio, every = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last()), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = sizes.withColumn("n", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("n") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("ratio", cap / w)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(budget))
    rows = rows.withColumn("k", F.row_number().over(by_ratio))
    rows = rows.withColumn("level", (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(w).over(after))
    rows = rows.withColumn("open", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(every))
    target = F.when(F.col("k") >= F.col("open.k"), F.least(cap, F.col("open.level") * w)).otherwise(cap)
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that only the seed and the source decide: 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit("\0null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def systematic(sized: DataFrame, seed: int = 17, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized (id, source, size) -> id, source, size, source_size, target, copies.

    Rows that share an id are one unit, emitted together: their sizes add up and the least source counts. A null id is an id, a null
    source a source, a null size 0. Ties are broken by an MD5 of seed and id, then by id, so reruns agree. No rows give none.
    """
    units = sized.groupBy("id").agg(F.min("source").alias("source"), F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("size"))
    hashed = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("id").cast("string"), F.lit("\0null"))).cast("binary"))
    units = keep(units.withColumn("h", hashed), "mix-units")
    units = units.withColumns({"b": F.substring("h", 1, 3), "cls": F.floor(F.log2(F.col("size") + 1) * 8).cast("int"), "src": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    key = ["src", "cls", "size", "b"]
    cells = keep(units.groupBy("source", *key).agg(F.count("*").alias("n")), "mix-cells")

    def starts(level: list[str], within: list[str]) -> DataFrame:
        """Of each cell of `level`, how many rows stand before it in its cell of `within`."""
        name, last = "s" + str(len(level)), level[-1]
        before = W.partitionBy(*within).orderBy(last).rowsBetween(W.unboundedPreceding, -1)
        return cells.groupBy(*level).agg(F.sum("n").alias("n")).select(*level, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))

    sizes = cells.groupBy("source", "src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = targets(sizes.select("source", "source_size"), weights, budget, most)
    aims = aims.select("source_size", "target", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), offset(F.col("source"), seed).alias("u"))
    aims = aims.withColumn("e", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)))
    plan = starts(key, key[:3]).join(starts(key[:3], key[:2]), key[:3]).join(starts(key[:2], key[:1]), key[:2]).join(aims, "src")
    plan = plan.select(*key, (F.col("s4") + F.col("s3") + F.col("s2")).alias("start"), "source_size", "target", "u", "e")
    ranked = units.withColumn("at", F.row_number().over(W.partitionBy(*key).orderBy("h", F.col("id").asc_nulls_last())) - 1).join(plan, key)
    rank = (F.col("start") + F.col("at")).cast("double")
    copies = F.floor(F.col("e") * (rank + 1.0) + F.col("u")) - F.floor(F.col("e") * rank + F.col("u"))
    return ranked.select("id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def word_count(text: Column) -> Column:
    from tamis.llm.common import WORD

    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, text, source, any others) -> the same columns, every row as often as the mix takes it: not at all up to `most` times.

    Rows that repeat an id are taken together; null ids are one id; rows without words come by their source's share. No rows give none.
    The text crosses the network once, to meet its row's number of copies; other rows of the plan hold numbers only.
    """
    sized = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    plan = systematic(sized, seed, weights, budget, most).filter("copies > 0").select(F.col("id").alias("__id"), F.col("copies").alias("__copies"))
    taken = docs.join(plan, docs["doc_id"].eqNullSafe(plan["__id"]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(docs[c] for c in docs.columns))
