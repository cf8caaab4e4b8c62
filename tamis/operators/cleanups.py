"""Clean-ups of documents, each with what it changed, and their write-back to a new tree with counters from the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.sources.files import FRONT, write_files


#: Of each clean-up what it does to a line of the body, or to a whole text and how it counts there; the latter leaves no frontmatter alone where it says so.
BY_LINE = {"fractions": lambda x: F.when(T.candidate_item(x), T.decimals_for_fractions(x)).otherwise(x), "headers": T.clean_header}
WHOLE = {"urls": (T.wrap_urls, lambda old, new: (old != new).cast("int"), True), "punctuation": (T.plain_punctuation, lambda old, _: T.odd_punctuation(old), False)}
RULES = (*BY_LINE, *WHOLE)


def cleaned(docs: DataFrame, rule: str) -> DataFrame:
    """docs (file, text, any others) -> file, text (cleaned), changes (of this rule: lines of `fractions` and `headers`, characters of `punctuation`, 1 for a
    text that `urls` changes). Frontmatter is kept byte for byte where the rule is for the body; a text none of whose lines changes is kept as it is,
    others are joined by line feeds. An empty body and a null text have no changes. Every stage is a projection over columns made once."""
    has = F.col("_old").rlike(FRONT) if rule in BY_LINE or WHOLE[rule][2] else F.lit(False)
    rows = docs.select("file", F.col("text").alias("_old")).withColumn("_body", F.when(has, F.coalesce(F.regexp_extract("_old", FRONT, 2), F.lit(""))).otherwise(F.col("_old")))
    if rule in BY_LINE:
        rows = rows.withColumn("_lines", T.lines(F.col("_body"))).withColumn("_made", F.transform("_lines", BY_LINE[rule]))
        changed = F.size(F.filter(F.arrays_zip("_lines", "_made"), lambda x: x["_lines"] != x["_made"]))
        rows = rows.withColumn("changes", changed).withColumn("_new", F.array_join("_made", "\n"))
    else:
        change, count, _ = WHOLE[rule]
        rows = rows.withColumn("_new", change(F.col("_body"))).withColumn("changes", count(F.col("_body"), F.col("_new")))
    rows = rows.withColumn("changes", F.when(F.col("_old").isNotNull(), F.coalesce("changes", F.lit(0))).otherwise(0).cast("long"))
    front = F.left("_old", F.length("_old") - F.length("_body"))
    return rows.select("file", F.when(F.col("changes") > 0, F.concat(front, "_new")).otherwise(F.col("_old")).alias("text"), "changes")


def write_back(docs: DataFrame, rule: str, root: str, changed_only: bool = False) -> dict[str, int]:
    """Writes cleaned documents to a new tree below `root`, one file a row at its `file` (a relative path), and tells written, files (read), changed (files) and changes.

    The counters are observed on the rows that are written, in the same pass; the input is not touched. Rows of null texts are counted, not written.
    """
    counters = {"files": F.count("*"), "changed": F.count_if(F.col("changes") > 0), "changes": F.coalesce(F.sum("changes"), F.lit(0))}
    only = F.col("text").isNotNull() & (F.col("changes") > 0 if changed_only else F.lit(True))
    return write_files(cleaned(docs, rule).withColumnRenamed("file", "path"), root, only, counters)
