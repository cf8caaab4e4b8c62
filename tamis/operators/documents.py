"""Documents to items and findings, end to end. Lines are windowed by file once; every producer of findings is a projection or a join of its rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.functions import markdown
from tamis.functions import text as T
from tamis.functions.dims import ALLOWED, DIMENSIONS, SEVERITY
from tamis.functions.workers import importable
from tamis.operators import blocks, findings, grammar, search
from tamis.operators.windows import ahead, in_fence, upto
from tamis.sources.stages import kept, parts, release, spread

#: Shares of a line's words and of its pairs of words that a parse has to hold.
WORDS, PAIRS = 0.85, 0.85
#: Dropped lines no farther apart are one run; so many of its further lines are told.
GAP, TOLD = 2, 12
#: Different items, at most, that are read once and broadcast; where there are more, each row is read.
FEW = 16_384


def structure(docs: DataFrame) -> DataFrame:
    """docs (file, text) -> routed lines, bare web addresses wrapped."""
    return blocks.routed(blocks.classified(docs.select("file", T.wrap_urls(F.col("text")).alias("text"))))


def ingredients(rows: DataFrame) -> DataFrame:
    """routed lines -> parsed items of ingredients: file, rec, title, component, ln, item (its number in the record, from 0), body and the grammar's columns."""
    return _read(_numbered(rows), grammar.item)


def _read(own: DataFrame, item: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    out = item(own.filter("section = 'ingredients'"), "body").withColumn("optional", F.col("optional") | F.col("group_optional"))
    return out.drop("kind", "level", "indent", "inferred", "group_optional")


def steps(rows: DataFrame) -> DataFrame:
    """routed lines -> all other items as they are, with the temperatures and durations they tell."""
    return _told(_numbered(rows))


def _told(own: DataFrame) -> DataFrame:
    return own.filter("section <> 'ingredients'").select("file", "rec", "title", "section", "component", "ln", "item", "body", T.temperatures(F.col("body")).alias("temperatures"), T.durations(F.col("body")).alias("durations"))


def _numbered(rows: DataFrame) -> DataFrame:
    return blocks.items(rows).withColumn("item", F.row_number().over(W.partitionBy("file", "rec").orderBy("ln")) - 1)


def _finding(rows: DataFrame, code: str, producer: int, message: Column, context: Column | None = None, line: Column | None = None, detail: Column | None = None) -> DataFrame:
    text, lines = F.lit(None).cast("string"), F.array().cast("array<string>")
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    return rows.select("file", "rec", "title", F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), message.alias("message"), (text if context is None else context).alias("context"), at.alias("line"), (lines if detail is None else detail).alias("detail"), F.struct(F.lit(producer).alias("producer"), F.coalesce("rec", F.lit(0)).alias("rec"), F.coalesce(at, F.lit(0)).alias("line")).alias("emit_ord"))


def characters(docs: DataFrame) -> DataFrame:
    """Characters beyond ASCII that are not allowed, each once a line."""
    importable(docs.sparkSession)
    rows = docs.select("file", F.posexplode(T.lines(F.col("text"))).alias("i", "x")).select("file", F.lit(None).cast("int").alias("rec"), F.lit(None).cast("string").alias("title"), (F.col("i") + 1).alias("ln"), "x", F.explode(T.foreign(F.col("x"), ALLOWED)).alias("c"))
    return _finding(rows, "non-ascii-character", 0, F.concat(F.lit("Character U+"), F.lpad(F.hex(F.ascii("c")), 4, "0"), F.lit(" ("), T.character_name(F.col("c")), F.lit(") is not allowed.")), T.strip(F.col("x")), F.col("ln"))


def inferred_yields(rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    lax = blocks.lax_yields(rows, "title").join(blocks.yields(rows, metadata).hint("merge"), ["file", "rec"], "left_anti")
    return _finding(lax, "yield-inferred", 1, F.concat(F.lit("The yield was inferred from: "), F.col("yield")), F.col("yield"), F.col("line"))


def invalid_measures(items: DataFrame) -> list[DataFrame]:
    """Terms of classes that are no amounts, and containers that cannot hold what they are said to."""
    each = items.withColumn("t", F.explode(F.concat("amounts", F.flatten(F.transform("alternatives", lambda a: a["terms"])))))
    kind, inner = F.col("t.unit_class"), F.col("t.nested.unit_class")
    wrong = each.filter(kind.isin("duration", "temperature"))
    nested = each.filter(~kind.isin("duration", "temperature") & F.col("t.nested").isNotNull())
    return [
        _finding(wrong, "invalid-unit-class", 2, F.concat(F.lit("A unit of class "), kind, F.lit(" measures no amount.")), F.col("body"), F.col("ln")),
        _finding(nested.filter(kind != "piece"), "invalid-nesting", 2, F.concat(F.lit("Only pieces hold something, not a "), kind, F.lit(".")), F.col("body"), F.col("ln")),
        _finding(nested.filter(~inner.isin("volume", "weight")), "invalid-nesting", 2, F.concat(F.lit("A container holds a volume or weight, not a "), inner, F.lit(".")), F.col("body"), F.col("ln")),
    ]


def conversions(items: DataFrame) -> DataFrame:
    rows = findings.mass_conflicts(items)
    return _finding(rows, "conversion-discrepancy", 2, F.concat(F.lit("The two amounts of "), F.col("name"), F.lit(" differ by "), F.call_function("format_number", F.col("gap") * 100, F.lit("0.0")), F.lit("%.")), F.col("body"), F.col("ln"))


def temperatures(own: DataFrame) -> DataFrame:
    rows = own.filter("section = 'directions'").withColumn("gap", findings.temperature_conflict(F.col("temperatures"))).filter("gap IS NOT NULL")
    return _finding(rows, "temperature-discrepancy", 2, F.concat(F.get("temperatures", F.lit(0)), F.lit(" and "), F.get("temperatures", F.lit(1)), F.lit(" are not the same.")), F.col("body"), F.col("ln"))


def components(rows: DataFrame) -> DataFrame:
    two = rows.filter("kind = 'heading' AND level = 2 AND section <> 'notes'")
    lost = findings.unmatched_components(two.select("file", "rec", "title", "section", "component"), "title")
    return _finding(lost, "component-without-directions", 3, F.concat(F.lit("No directions for "), F.col("component"), F.lit(".")), F.col("component"))


def sections(rows: DataFrame) -> list[DataFrame]:
    lost = findings.missing_sections(rows, "title")
    told = {"no-section-headings": "No headings: sections are guessed.", "missing-ingredients-section": "No section of ingredients.", "missing-directions-section": "No section of directions."}
    lists = rows.filter("inferred").groupBy("file", "rec", "title", "section", "ordered").agg(F.count("*").alias("n"), F.min("ln").alias("ln"))
    return [_finding(lost.filter(F.col("code") == code), code, 4, F.lit(text)) for code, text in told.items()] + [
        _finding(lists, "section-inferred", 4, F.concat(F.lit("A list of "), F.col("n"), F.lit(" items was taken for "), F.col("section"), F.lit(".")), line=F.col("ln"))
    ]


def starts_with_quantity(x: Column) -> Column:
    return F.ltrim(F.regexp_replace(F.ltrim(x, F.lit(" \t")), r"^[~(\[]", ""), F.lit(" \t")).rlike("^[0-9¼-¾⅐-⅞]")


def dimensional(x: Column) -> Column:
    """Whether a leading number tells a size: behind its digits and signs stands a word of lengths or percents."""
    return F.lower(F.regexp_extract(x, r"^[\s~]*[\d./–—-][\d./\s–—-]*([A-Za-z]+|%(?=\w))", 1)).isin(*DIMENSIONS)


def completeness(items: DataFrame) -> list[DataFrame]:
    every = F.concat("amounts", F.flatten(F.transform("alternatives", lambda a: a["terms"])))
    body, ln = F.col("body"), F.col("ln")
    none = items.filter(F.col("name").isNotNull() & (F.size(every) == 0) & starts_with_quantity(body))
    counts = items.withColumn("t", F.explode(every)).filter("t.implicit")
    return [
        _finding(items.filter("name IS NULL"), "quantity-unparsed", 4, F.lit("Nothing could be read from the line."), body, ln),
        _finding(none.filter(~dimensional(body)), "quantity-unparsed", 4, F.lit("The line begins with a number, but no amount was read."), body, ln),
        _finding(none.filter(dimensional(body)), "dimension-not-quantity", 4, F.lit("The leading number tells a size, not an amount."), body, ln),
        _finding(items.filter(T.strip(F.col("name")) == ""), "ingredient-name-empty", 4, F.lit("The line names nothing."), body, ln),
        _finding(counts, "implicit-count-unit", 4, F.concat(F.lit("Read as a count of "), F.col("t.value"), F.lit(".")), body, ln),
    ]


#: A thematic break, a level-1 heading and a fence as coverage sees them: in lines as they are, without block structure.
_BREAK, _TITLE, _FENCE = r"^(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", r"^#(?:\s|$)", r"^\s{0,3}(?:```|~~~)"


def spans(lines: DataFrame, records: DataFrame) -> DataFrame:
    """lines (file, ln, line, any others), records (file, n: how many were parsed) -> lines with rec: the record whose span of lines holds it.

    A break outside fences starts a span where the next content, further breaks aside, is a level-1 heading and there is content behind the
    break before. Where a file's spans are not as many as its records, attribution is abandoned: rec is null for the whole file, as it is for
    files of one record or none. Breaks, starts and lines are told apart by one running sum, so nothing is gathered.
    """
    by, order = ["file"], [F.col("ln")]
    x = T.strip(F.col("line"))
    fence = F.col("line").rlike(_FENCE)
    rows = lines.withColumns({"_x": x, "_fence": fence}).withColumn("_in", in_fence(F.col("_fence"), by, order) | F.col("_fence"))
    bare = F.col("_x").rlike(_BREAK)
    rows = rows.withColumn("_said", (F.col("_x") != "") & ~bare).withColumn("_next", ahead(F.when(F.col("_said"), F.col("_x")), by, order))
    rows = rows.withColumn("_cut", bare & ~F.col("_in") & F.coalesce(F.col("_next").rlike(_TITLE), F.lit(False)))
    rows = rows.withColumn("_n", F.sum(F.col("_said").cast("int")).over(upto(by, order)))
    before = F.last(F.when(F.col("_cut"), F.col("_n")), ignorenulls=True).over(W.partitionBy("file").orderBy("ln").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_start", (F.col("_cut") & (F.col("_n") > F.coalesce(before, F.lit(0)))).cast("int"))
    rows = rows.withColumn("_rec", 1 + F.sum("_start").over(upto(by, order))).withColumn("_all", F.max("_rec").over(W.partitionBy("file")))
    rows = rows.join(records.select("file", F.col("n").alias("_records")).hint("merge"), "file", "left")
    return rows.select(*lines.columns, F.when((F.col("_records") > 1) & (F.col("_all") == F.col("_records")), F.col("_rec")).alias("rec"))


def located(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Findings whose context is a line's content, with line as the first line of their file that holds it; null where it spans lines or no line does."""
    lines = docs.select("file", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).select("file", (F.col("i") + 1).alias("ln"), "line")
    probes = found.select("file", "context").distinct()
    where = search.first_lines(lines, probes.select("file", F.col("context").alias("id"), F.col("context").alias("probe")))
    where = where.select(F.col("file").alias("_f"), F.col("id").alias("_c"), F.col("ln").alias("_ln"))
    rows = found.join(where.hint("merge"), F.col("file").eqNullSafe(F.col("_f")) & F.col("context").eqNullSafe(F.col("_c")), "left")
    return rows.select(*(F.col("_ln").cast("int").alias("line") if c == "line" else F.col(c) for c in found.columns))


def dropped(docs: DataFrame, rows: DataFrame, n: int = 1) -> DataFrame:
    """Source lines that left no trace in what was parsed: file, rec, title, ln, line. A line stays if enough of its words and of their pairs are in the record that
    its span belongs to, or in any of the file's where spans() tells none; a line without words, if its characters are. rec and title are null where a file
    of several records was not attributed. Lines and what was parsed of them are dealt by file over n tasks; neither is broadcast, as both grow with the files."""
    own = spread(rows, n, "file").filter(~F.col("kind").isin("break", *markdown.SILENT))
    records = own.groupBy("file").agg(F.size(F.collect_set("rec")).alias("n"))
    lines = docs.select("file", F.posexplode(F.split(T.without_comment_text(F.col("text")), "\n", -1)).alias("i", "line")).select("file", (F.col("i") + 1).alias("ln"), "line")
    lines = spans(spread(lines, n, "file"), records).withColumn("x", T.strip(F.col("line"))).filter("x <> ''")
    # a group's header stands for its items
    depth = F.when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\S"), F.length(F.regexp_extract("line", r"^\s*", 0))).otherwise(-1)
    lines = lines.withColumn("depth", depth).withColumn("next", ahead(F.col("depth"), ["file"], [F.col("ln")]))
    group = F.col("x").rlike(r"(?i)^(?:[-*+]|\d+[.)])?\s*optional\s*:?$") & (F.col("depth") >= 0) & (F.col("next") > F.col("depth"))
    content = T.content_of(F.col("x"))
    meant = content.rlike(r"^\[//\]:\s*#\s*\(.*\)$") | content.rlike(r"^\[[^\]]+\]:\s+\S") | F.coalesce(group, F.lit(False))
    lines = lines.filter(~meant).select("file", "rec", "ln", "line", content.alias("content"), F.coalesce("rec", F.lit(0)).cast("long").alias("_rec"))
    # what was parsed, by record and, as record 0, by file: only one of the two is looked at
    said = own.select("file", "title", "rec", F.explode(F.array("rec", F.lit(0)).cast("array<long>")).alias("_rec"), F.struct("ln", "body").alias("b"))
    told = said.groupBy("file", "_rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["body"]), " ").alias("said"), F.first("title").alias("title"), (F.size(F.collect_set("rec")) == 1).alias("one"))
    index = spread(told, n, "file", "_rec").withColumn("t", T.tokens(T.normalised(F.col("said"))))
    index = index.select("file", "_rec", "title", "one", F.array_distinct("t").alias("words"), F.array_distinct(T.bigrams(F.col("t"))).alias("pairs"), T.collapsed(F.col("said")).alias("verbatim"))
    lines = spread(lines, n, "file", "_rec").join(index.hint("merge"), ["file", "_rec"], "left")
    none = F.array().cast("array<string>")
    lines = lines.withColumns({"words": F.coalesce("words", none), "pairs": F.coalesce("pairs", none), "verbatim": F.coalesce("verbatim", F.lit(""))})
    lines = lines.withColumn("t", T.tokens(T.normalised(F.col("content")))).withColumn("residue", T.collapsed(F.col("content")))
    words = (T.share_in(F.col("t"), F.col("words")) >= WORDS) & F.coalesce(T.share_in(T.bigrams(F.col("t")), F.col("pairs")) >= PAIRS, F.lit(True))
    stays = F.when(F.size("t") > 0, words).otherwise(T.structure_only(F.col("residue")) | F.contains("verbatim", F.col("residue")))
    only = F.col("rec").isNull() & F.col("one")
    return lines.filter(~stays).select("file", F.when(only, F.lit(1)).otherwise(F.col("rec")).alias("rec"), F.when(only | F.col("rec").isNotNull(), F.col("title")).alias("title"), "ln", F.rtrim("line").alias("line"))


def coverage(lost: DataFrame) -> DataFrame:
    """dropped() lines -> a finding for each run of them."""
    w = W.partitionBy("file", "rec").orderBy("ln")
    lost = lost.withColumn("new", (F.coalesce(F.col("ln") - F.lag("ln").over(w), F.lit(1 << 30)) > GAP).cast("int"))
    lost = lost.withColumn("run", F.sum("new").over(upto(["file", "rec"], [F.col("ln")])))
    runs = lost.groupBy("file", "rec", "title", "run").agg(F.count("*").alias("n"), F.min("ln").alias("first"), F.max("ln").alias("last"), F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("x"))
    span = F.when(F.col("n") == 1, F.concat(F.lit("line "), F.col("first"))).otherwise(F.concat(F.lit("lines "), F.col("first"), F.lit("-"), F.col("last")))
    told = F.transform(F.slice("x", 2, TOLD), lambda y: F.concat(F.lit("line "), y["ln"], F.lit(": "), T.strip(y["line"])))
    more = F.when(F.col("n") - 1 > TOLD, F.array(F.concat(F.lit("... and "), F.col("n") - 1 - TOLD, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return _finding(runs, "source-content-dropped", 5, F.concat(F.col("n"), F.lit(" lines lost at "), span, F.lit(".")), F.get("x", F.lit(0))["line"], F.col("first"), F.concat(told, more))


def all_findings(docs: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """docs (file, text) -> all findings, in the order of their producers, each once: file, rec, title, code, severity, message, context, line, detail, emit_ord.

    Null texts have no lines and no findings; files are told apart by name, so repeated files count as one with their lines repeated. Texts, lines and items
    are read by many producers, so they are made once and written as Parquet to the folder of spark.checkpoint.dir; the findings, which are few, are written there
    too, and then what they were made of is deleted. What is read again is dealt by file over as many tasks as the number of texts asks, since its files are
    packed many times smaller than its rows; nothing that grows with the files is broadcast.
    """
    n = parts(docs)
    docs = kept(spread(docs.select("file", "text"), n), "docs")
    rows = kept(structure(docs), "lines")
    by_file = spread(rows, n, "file")
    own = kept(_numbered(by_file), "numbered")
    items = kept(_read(own, lambda x, c: grammar.once(x, c, grammar.item, FEW)), "items")
    lost, raised = kept(dropped(docs, rows, n), "dropped"), kept(reduce(DataFrame.unionByName, completeness(items)), "completeness")
    at = kept(located(docs, raised), "located")
    found = [characters(docs), inferred_yields(by_file, metadata), *invalid_measures(items), conversions(items), temperatures(_told(own)), components(by_file), *sections(by_file), at, coverage(lost)]
    out = kept(findings.deduplicated(spread(reduce(DataFrame.unionByName, found), n, "file")), "findings")
    release(docs, rows, own, items, lost, raised, at)
    return out


def report(found: DataFrame) -> DataFrame:
    """One row: how many files have findings, findings by severity, and failed (whether there is an error)."""
    of = lambda s: F.count_if(F.col("severity") == s).alias(s + "s")
    return found.agg(F.countDistinct("file").alias("files"), *map(of, findings.SEVERITIES), F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed"))


def file_report(rows: DataFrame, found: DataFrame, shown: Column | None = None) -> DataFrame:
    """routed lines and findings -> a row per file: file, records, findings, shown (those that the filter `shown` lets through, all by default), suppressed,
    errors, warnings, infos, and messages of those shown, worst first, then by code and line. Files without records or findings have zeros and no messages;
    findings count whether shown or not."""
    see = F.lit(True) if shown is None else F.coalesce(shown, F.lit(False))
    of = lambda s: F.count_if(F.col("severity") == s).alias(s + "s")
    rank = F.array_position(F.array(*map(F.lit, findings.SEVERITIES)), F.col("severity"))
    place = F.concat_ws(" ", F.col("severity"), F.col("code"), F.when(F.col("line").isNotNull(), F.concat(F.lit("line "), F.col("line"))), F.col("message"))
    told = F.when(see, F.struct(rank.alias("rank"), F.col("code").alias("code"), F.coalesce("line", F.lit(0)).alias("line"), place.alias("text")))
    by_file = found.groupBy("file").agg(F.count("*").alias("findings"), F.count_if(see).alias("shown"), *map(of, findings.SEVERITIES), F.transform(F.array_sort(F.collect_list(told)), lambda x: x["text"]).alias("messages"))
    records = rows.groupBy("file").agg(F.countDistinct("rec").alias("records"))
    both = records.join(by_file, "file", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("file", zero("records"), zero("findings"), zero("shown"), (F.coalesce("findings", F.lit(0)) - F.coalesce("shown", F.lit(0))).cast("long").alias("suppressed"), *(zero(s + "s") for s in findings.SEVERITIES), F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))


def code_counts(found: DataFrame) -> DataFrame:
    """Findings by code, most first; of equals the code that was found first: code, n."""
    counts = found.groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct("file", "emit_ord")).alias("first"))
    return counts.orderBy(F.col("n").desc(), "first", "code").select("code", "n")
