"""Documents to lines, records, blocks and items. One shuffle by file; all windows share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.functions import markdown
from tamis.functions import text as T
from tamis.functions.dims import LAX_YIELD_WORDS, NO_YIELDS, NUMBER_WORDS, YIELD_WORDS, YIELD_KEYS
from tamis.functions.workers import importable
from tamis.operators.windows import ahead, carried, upto
from tamis.sources.stages import parts, spread

SECTION = r"(?i)^(ingredients|directions|instructions|method)(?:\s+for\s+(.+))?$"


def classified(docs: DataFrame) -> DataFrame:
    """docs (file, text) -> file, ln (from 1), line, kind, level, body, indent, ordered, block: what each line is by CommonMark's block rules.

    A text is one value of one row, so its lines are told apart by one pass over it inside the task that reads it, before anything is shuffled; the state of
    that pass is what containers and leaves are open. Kinds, body and block are those of markdown.classify(); indent is an item's depth in its list and
    ordered tells of the outermost list. A heading written over a line of `=` or `-` holds all lines of its paragraph, an item all its own paragraphs, both
    on their first line. Items without text, comments aside, are lost. Null and empty texts have no lines.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.select("file").schema}
    importable(docs.sparkSession)
    text = F.regexp_replace("text", r"^\x{FEFF}", "")
    n = parts(docs)
    rows = spread(docs.select(F.col("file").cast("string"), text.alias("text")).filter("text IS NOT NULL"), n)
    rows = rows.mapInArrow(markdown.lines, "file string, ln int, line string, kind string, level int, body string, depth int, ordered boolean, block int")
    item = F.col("kind") == "item"
    bare = F.when(item & F.contains("body", F.lit("<!--")) | item & F.contains("body", F.lit("[//]:")), T.strip_comments(F.col("body"))).otherwise(F.col("body"))
    rows = rows.withColumn("body", bare)
    kind = F.when(item & (F.col("body") == ""), "lost").otherwise(F.col("kind"))
    rows = rows.select(F.col("file").cast(kinds["file"]), "ln", "line", kind.alias("kind"), "level", "body", F.coalesce("depth", F.lit(0)).alias("indent"), F.coalesce("ordered", F.lit(False)).alias("ordered"), "block")
    # the number of tasks follows the number of texts, in which lines come many to one
    return spread(rows, n, "file")


def lists(lines: DataFrame) -> DataFrame:
    """classified lines -> file, block, ordered, until, text: each outermost list with its source lines as they are, nested ones and blank lines between included."""
    rows = lines.filter("kind <> 'blank'").groupBy("file", "block").agg(F.max(F.col("kind").isin("item", "mark")).alias("is"), F.max("ln").alias("until"), F.bool_or(F.col("ordered")).alias("ordered"))
    spans = rows.filter("is").drop("is")
    own = lines.select("file", "block", "ln", "line").join(spans, ["file", "block"]).filter("ln <= until")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    return own.groupBy("file", "block", "ordered", "until").agg(text.alias("text"))


def quotes(lines: DataFrame) -> DataFrame:
    """classified lines -> file, block, text: each quote with the contents of its lines, joined by spaces."""
    said = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("ln", "body"))))
    return lines.filter("kind = 'quote'").groupBy("file", "block").agg(F.array_join(F.transform(said, lambda x: x["body"]), " ").alias("text"))


def routed(lines: DataFrame) -> DataFrame:
    """classified lines -> with rec (record of the file, from 1), title, section (ingredients, directions or notes) and component.

    A break starts a record where the next heading, further breaks aside, is of level 1. Section and component are carried forward inside a
    record from its level-2 headings; without any, unordered items before the first ordered one are ingredients, ordered ones directions.
    """
    by, order = ["file"], [F.col("ln")]
    silent = F.col("kind").isin(*markdown.SILENT)
    content = F.when(~silent & (F.col("kind") != "break"), F.struct("kind", "level"))
    rows = lines.withColumn("next", ahead(content, by, order))
    cut = (F.col("kind") == "break") & (F.col("next.kind") == "heading") & (F.col("next.level") == 1)
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("rec", F.sum("cut").over(upto(by, order)))
    rows = rows.filter("cut = 0").withColumn("full", F.max((~silent).cast("int")).over(W.partitionBy("file", "rec"))).filter("full = 1")
    rows = rows.withColumn("rec", F.dense_rank().over(W.partitionBy("file").orderBy("rec")))
    own = ["file", "rec"]
    whole = W.partitionBy(*own).orderBy("ln").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    head = F.lower(T.header(F.col("body")))
    two = (F.col("kind") == "heading") & (F.col("level") == 2)
    part = F.regexp_extract(head, SECTION, 1)
    section = F.when(two, F.when(part == "ingredients", "ingredients").when(part != "", "directions").otherwise("notes"))
    component = F.when(two, F.when(part != "", F.coalesce(F.nullif(T.strip(F.regexp_extract(T.header(F.col("body")), SECTION, 2)), F.lit("")), F.lit("Main"))).otherwise(F.lit("")))
    h1 = F.first(F.when((F.col("kind") == "heading") & (F.col("level") == 1), T.header(F.col("body"))), ignorenulls=True).over(whole)
    rows = rows.withColumns({"title": F.coalesce(F.nullif(h1, F.lit("")), F.concat(F.lit("Recipe "), F.col("rec"))), "has_two": F.max(two.cast("int")).over(whole) == 1, "s": carried(section, own, order), "c": carried(component, own, order)})
    seen = F.coalesce(F.max(((F.col("kind") == "item") & F.col("ordered")).cast("int")).over(upto(own, order)), F.lit(0)) == 1
    guess = F.when((F.col("kind") == "item"), F.when(F.col("ordered"), "directions").when(~seen, "ingredients").otherwise("notes"))
    return rows.select("file", "rec", "ln", "line", "kind", "level", "body", "indent", "ordered", "block", "title", F.when(F.col("has_two"), F.coalesce("s", F.lit("notes"))).otherwise(F.coalesce(guess, F.lit("notes"))).alias("section"), F.nullif("c", F.lit("")).alias("component"), (~F.col("has_two") & (F.col("kind") == "item")).alias("inferred"))


def items(rows: DataFrame) -> DataFrame:
    """The items of routed lines, with group_optional: under a bare `optional` item that heads a deeper list and vanishes itself."""
    w = W.partitionBy("file", "rec").orderBy("ln")
    own = rows.filter("kind = 'item'").withColumn("under", F.lead("indent").over(w))
    heads = F.col("body").rlike(r"(?i)^\s*optional\s*:?\s*$") & (F.col("under") > F.col("indent")) & (F.col("section") != "directions")
    own = own.withColumn("heads", F.coalesce(heads, F.lit(False)))
    # the last item at or above a group's depth ends it
    group = F.last(F.when(F.col("heads"), F.struct(F.col("indent").alias("i"), F.lit(True).alias("on"))), ignorenulls=True).over(upto(["file", "rec"], [F.col("ln")]))
    own = own.withColumn("g", group).withColumn("gl", F.last(F.when(F.col("heads"), F.col("ln")), ignorenulls=True).over(upto(["file", "rec"], [F.col("ln")])))
    low = F.min("indent").over(W.partitionBy("file", "rec", "gl").orderBy("ln").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("after", F.min(F.when(~F.col("heads"), F.col("indent"))).over(W.partitionBy("file", "rec", "gl").orderBy("ln").rowsBetween(W.unboundedPreceding, 0))).withColumn("low", low)
    return own.filter(~F.col("heads")).withColumn("group_optional", F.coalesce(F.col("after") > F.col("g.i"), F.lit(False))).drop("g", "gl", "after", "low", "heads", "under")


def tables(rows: DataFrame) -> DataFrame:
    """Table rows of routed lines -> file, rec, tab (the number of its first line), ln, cells as wide as the header's: padded or cut. The delimiter row is left out."""
    cells = F.transform(F.split(F.regexp_replace("body", r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|", -1), lambda x: F.replace(T.strip(x), F.lit("\\|"), F.lit("|")))
    own = rows.filter("kind = 'row'").select("file", "rec", F.col("block").alias("tab"), "ln", cells.alias("cells"))
    own = own.withColumn("width", F.first(F.size("cells")).over(W.partitionBy("file", "rec", "tab").orderBy("ln")))
    pad = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.col("width") - F.size("cells"))))
    return own.select("file", "rec", "tab", "ln", F.slice(pad, F.lit(1), F.col("width")).alias("cells"))


def _number(x: Column) -> Column:
    return x.rlike(r"(?i)\d|\b(?:" + "|".join(NUMBER_WORDS) + r")\b")


def _told(x: Column, words: list[str], start: str) -> Column:
    return x.rlike(rf"(?i){start}(?:" + "|".join(words) + r")\b") & (F.size(F.split(x, r"\s+")) <= 8) & _number(x)


def yields(rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """routed lines -> file, rec, yield: what the file's metadata (file, metadata: a JSON text) tells under the first of some keys, or else the
    first text line before the first level-2 heading that begins with a yield word, has at most eight words and a number."""
    own = rows.withColumn("two", F.max(((F.col("kind") == "heading") & (F.col("level") == 2)).cast("int")).over(upto(["file", "rec"], [F.col("ln")])))
    body = F.trim(F.btrim("body", F.lit("*+-")))
    found = own.filter((F.col("two") == 0) & (F.col("kind") == "text") & _told(body, YIELD_WORDS, "^")).groupBy("file", "rec").agg(F.min_by(body, F.col("ln")).alias("yield"))
    if metadata is None:
        return found
    keys = F.coalesce(*(F.trim(F.get_json_object("metadata", f"$.{k}")) for k in YIELD_KEYS))
    told = rows.select("file", "rec").distinct().join(metadata.select("file", keys.alias("told")), "file").filter("told IS NOT NULL")
    return told.join(found, ["file", "rec"], "full").select("file", "rec", F.coalesce("told", "yield").alias("yield"))


def lax_yields(rows: DataFrame, *more: str) -> DataFrame:
    """routed lines -> file, rec, more columns that a record has one value of, line, yield: the first text line anywhere that seems to tell a yield."""
    body = F.trim(F.btrim("body", F.lit("*+-")))
    low = F.lower(body)
    none = F.lit(False)
    for start in NO_YIELDS:
        none = none | low.startswith(start)
    ok = (F.col("kind") == "text") & ~none & ~(low.startswith("serve") & ~_number(body)) & _told(body, LAX_YIELD_WORDS, r"\b")
    return rows.filter(ok).groupBy("file", "rec", *more).agg(F.min("ln").alias("line"), F.min_by(body, F.col("ln")).alias("yield"))


def written(rows: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """routed lines, and told (file, rec, yield) where a yield stands outside the text -> file, rec, text: each record as Markdown again.

    Title first, then headings, paragraphs, quotes, lists (flat, numbered from 1 where ordered) and tables in their order, a blank line around each, so
    that reading it again gives the same rows but for places, depths and what yields nothing. A table's cells are as wide as its header; a
    yield is written where no text of the record says it. Blocks of a record, and lines of a block, meet in one row.
    """
    at = lambda kind: rows.filter(F.col("kind") == kind)
    joined = lambda x, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", x.alias("x")))), lambda y: y["x"]), by)
    own = ["file", "rec", "block"]
    heads = at("heading").filter("level > 1").select(*own, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), T.header(F.col("body"))).alias("text"))
    texts = at("text").groupBy(*own).agg(joined(F.col("body"), "\n").alias("text"))
    cited = at("quote").filter("body <> ''").groupBy(*own).agg(F.concat(F.lit("> "), joined(F.col("body"), " ")).alias("text"))
    numbered = at("item").withColumn("n", F.row_number().over(W.partitionBy(*own).orderBy("ln")))
    mark = F.when(F.col("ordered"), F.concat(F.col("n").cast("string"), F.lit(". "))).otherwise(F.lit("* "))
    listed = numbered.groupBy(*own).agg(joined(F.concat(mark, F.regexp_replace("body", "\n", "\n  ")), "\n").alias("text"))
    bar = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    grid = tables(rows).withColumnRenamed("tab", "block").withColumn("cells", F.transform("cells", lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))
    line = F.when(F.col("ln") == F.col("block"), F.concat(bar(F.col("cells")), F.lit("\n"), bar(F.transform("cells", lambda _: F.lit("---"))))).otherwise(bar(F.col("cells")))
    drawn = grid.groupBy(*own).agg(joined(line, "\n").alias("text"))
    every = heads.unionByName(texts).unionByName(cited).unionByName(listed).unionByName(drawn)
    body = every.groupBy("file", "rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: F.concat(F.lit("\n"), x["text"], F.lit("\n"))), "").alias("body"))
    titles = rows.groupBy("file", "rec").agg(F.first("title").alias("title"))
    out = titles.join(body, ["file", "rec"], "left")
    out = out.join(told, ["file", "rec"], "left") if told is not None else out.withColumn("yield", F.lit(None).cast("string"))
    more = F.when(F.col("yield").isNotNull() & ~F.contains(F.coalesce("body", F.lit("")), F.col("yield")), F.concat(F.lit("\n"), F.col("yield"), F.lit("\n"))).otherwise(F.lit(""))
    return out.select("file", "rec", F.concat(F.lit("# "), F.col("title"), F.lit("\n"), more, F.coalesce("body", F.lit(""))).alias("text"))
