"""Registered queries of the parsing and quality operators over the driver's tables, each with SQL that computes the answer another way.

The tables hold no item lines, so many queries write lines from numeric columns and recover them; their SQL works on the numbers alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tamis.functions import markdown
from tamis.functions import numbers as N
from tamis.functions import text as T
from tamis.operators import blocks, catalog, cleanups, documents, findings, grammar, search, units, windows
from tamis.sources import files
from tamis.sources.stages import kept, parts, spread

#: Rows that a task gathers into texts.
GATHERED = 65_536
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def txt(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def whole(c: str) -> Column:
    return F.col(c).cast("long")


FOODS = ("water", "whole milk", "olive oil", "butter")


def one_of(values: tuple, key: Column) -> Column:
    """The value that a key chooses, by turns."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@query("""
SELECT ['water','whole milk','olive oil','butter'][l_partkey % 4 + 1] AS food, count(*) AS n,
  round(sum(l_quantity::BIGINT * 240.0::DOUBLE * [1.0,1.03,0.91,0.96][l_partkey % 4 + 1]::DOUBLE), 3) AS grams
FROM lineitem GROUP BY 1""")
def parse_and_weigh(spark, d):
    """The whole path of an item line: amount, unit, name, density, grams, sums by food."""
    rows = table(spark, d, "lineitem").select(txt("- ", whole("l_quantity"), " cups ", one_of(FOODS, F.col("l_partkey"))).alias("line"))
    # a line that many rows write is read once and counts as often
    rows = grammar.item(rows.groupBy("line").agg(F.count("*").alias("k")), "line").select("name", F.get("amounts", F.lit(0)).alias("t"), "k")
    rows = units.with_grams(rows, "t", "name", "w")
    return rows.groupBy(F.col("name").alias("food")).agg(F.sum("k").alias("n"), F.round(F.sum(F.col("w.value") * F.col("k")), 3).alias("grams"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity / (l_suppkey % 7 + 2)
  WHEN 2 THEN l_quantity + (l_suppkey % 3 + 1) / 4.0::DOUBLE ELSE l_quantity + [0.25,0.5,0.75][l_suppkey % 3 + 1]::DOUBLE END AS value FROM lineitem""")
def quantity_scalar(spark, d):
    q, k = whole("l_quantity"), F.col("l_suppkey")
    v = one_of(("¼", "½", "¾"), k)
    n = F.col("l_linenumber") % 4
    text = F.when(n == 0, txt("~", q)).when(n == 1, txt(q, "/", k % 7 + 2)).when(n == 2, txt(q, " ", k % 3 + 1, "/4")).otherwise(txt(q, v))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t")).transform(lambda r: N.with_bounds(r, "t", "b")).select("l_orderkey", "l_linenumber", F.col("b.value").alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, least(a, b) AS lo, greatest(a, b) AS hi, (a + b) / 2 AS value
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, (l_suppkey % 60)::DOUBLE AS b FROM lineitem)""")
def quantity_range(spark, d):
    q, b, n = whole("l_quantity"), F.col("l_suppkey") % 60, F.col("l_linenumber") % 3
    text = F.when(n == 0, txt(q, "-", b)).when(n == 1, txt(q, " to ", b)).otherwise(txt(q, " – ", b))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t")).transform(lambda r: N.with_bounds(r, "t", "b"))
    return rows.select("l_orderkey", "l_linenumber", "b.lo", "b.hi", "b.value")


@query("""
SELECT p_partkey, ['tablespoon','kilogram','cup','pound','clove','inch'][p_partkey % 6 + 1] AS unit, ['volume','weight','volume','weight','piece','length'][p_partkey % 6 + 1] AS unit_class FROM part""")
def unit_lookup(spark, d):
    word = one_of(("Tbsp.", "KG", "cups", "lbs", "cloves", '"'), F.col("p_partkey"))
    rows = table(spark, d, "part").select("p_partkey", units.unit_of(word).alias("u"))
    return rows.select("p_partkey", "u.unit", "u.unit_class")


@query("""
SELECT l_returnflag, round(sum(l_quantity * [1.0,1000.0,28.349523125,453.59237][l_suppkey % 4 + 1]::DOUBLE), 3) AS grams, count(*) AS n FROM lineitem GROUP BY 1""")
def weight_grams(spark, d):
    unit = one_of(("g", "kg", "oz", "lb"), F.col("l_suppkey"))
    rows = table(spark, d, "lineitem").select("l_returnflag", txt(whole("l_quantity"), " ", unit, " stone").alias("line"))
    rows = rows.groupBy("l_returnflag", "line").agg(F.count("*").alias("k")).withColumn("name", F.lit("stone"))
    rows = units.with_grams(grammar.measured(rows, "line", "t"), "t", "name", "w")
    g = F.col("w.value")
    return rows.groupBy("l_returnflag").agg(F.round(F.sum(g * F.col("k")), 3).alias("grams"), F.sum(F.when(g.isNotNull(), F.col("k")).otherwise(0)).alias("n"))


PATTERNS = [("*red*", 1.0), ("*a*", 2.0), ("*steel*", 3.0), ("*e*t*", 4.0), ("*blue*", 5.0)]


@query("""
WITH k AS (SELECT p_partkey, translate(lower(p_name), ' -/', '___') AS key FROM part),
m AS (SELECT p_partkey, v, row_number() OVER (PARTITION BY p_partkey ORDER BY lit DESC, len DESC, ord) AS r FROM k,
  (VALUES ('%red%', 1.0::DOUBLE, 3, 5, 0), ('%a%', 2.0::DOUBLE, 1, 3, 1), ('%steel%', 3.0::DOUBLE, 5, 7, 2), ('%e%t%', 4.0::DOUBLE, 2, 5, 3), ('%blue%', 5.0::DOUBLE, 4, 6, 4)) p(pat, v, lit, len, ord) WHERE key LIKE pat)
SELECT k.p_partkey, m.v AS value FROM k LEFT JOIN m ON m.p_partkey = k.p_partkey AND r = 1""")
def glob_best_match(spark, d):
    rows = units.with_best_pattern(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", PATTERNS, "m")
    return rows.select("p_partkey", F.col("m.v0").alias("value"))


@query("""
SELECT p_partkey, p_size * [44.0,15.0,3.0,70.0][p_partkey % 4 + 1]::DOUBLE AS lo, p_size * [63.0,20.0,8.0,400.0][p_partkey % 4 + 1]::DOUBLE AS hi FROM part""")
def piece_grams_bounds(spark, d):
    name = one_of(("egg", "egg yolk", "garlic", "red onion"), F.col("p_partkey"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("name"), txt(F.col("p_size"), " ", name).alias("line"))
    rows = grammar.measured(rows, "line", "t", True)
    return units.with_grams(rows, "t", "name", "g").select("p_partkey", "g.lo", "g.hi")


@query("SELECT p_partkey, p_size * (p_partkey % 9 + 1) * 28.349523125::DOUBLE AS grams FROM part")
def nested_container(spark, d):
    rows = table(spark, d, "part").select("p_partkey", txt("- ", F.col("p_size"), " cans (", F.col("p_partkey") % 9 + 1, " oz each) beans").alias("line"))
    weighed = lambda x, c: units.with_grams(grammar.item(x, c).withColumn("t", F.get("amounts", F.lit(0))), "t", "name", "g").select(c, F.col("g.value").alias("grams"))
    return grammar.once(rows, "line", weighed).drop("line")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity * 1.25::DOUBLE AS lo, l_quantity * 1.75::DOUBLE AS hi, 'heaped' AS fill FROM lineitem""")
def heaped_interval(spark, d):
    q = whole("l_quantity")
    line = F.when(F.col("l_linenumber") % 2 == 0, txt(q, " heaped tbsp cocoa")).otherwise(txt("about ", q, " rounded tsp cocoa"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")).transform(lambda r: grammar.once(r, "line", lambda x, c: grammar.measured(x, c, "t")))
    return rows.select("l_orderkey", "l_linenumber", "t.lo", "t.hi", "t.fill")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 3 * l_quantity WHEN 1 THEN (l_quantity + l_quantity + 5) / 2 ELSE l_quantity END AS value,
  CASE WHEN l_linenumber % 3 = 2 THEN 'pound' ELSE 'gram' END AS unit FROM lineitem""")
def pack_and_dual_range(spark, d):
    q, n = whole("l_quantity"), F.col("l_linenumber") % 3
    line = F.when(n == 0, txt("3x ", q, "g spinach")).when(n == 1, txt(q, "g-", q + 5, "g tomatoes")).otherwise(txt(q, "-pound pumpkin"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")).transform(lambda r: grammar.once(r, "line", lambda x, c: grammar.measured(x, c, "t").select(c, "t.value", "t.unit")))
    return rows.drop("line")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 240.0::DOUBLE + l_linenumber * 15.0::DOUBLE AS grams FROM lineitem")
def additive_terms(spark, d):
    line = txt(whole("l_quantity"), " cups plus ", F.col("l_linenumber"), " tbsp water")
    weighed = lambda x, c: x.select(c, grammar.terms(F.col(c)).alias("ts"), units.looked_up(F.lit("water")).alias("k")).select(c, units.representation_bounds(F.col("ts"), F.col("k"))["hi"].alias("grams"))
    return grammar.once(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")), "line", weighed).drop("line")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS value,
  CASE p_partkey % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'inch' END AS unit FROM part""")
def counts_and_lengths(spark, d):
    s, n = F.col("p_size"), F.col("p_partkey") % 4
    line = F.when(n == 0, txt(s, " large lemons")).when(n == 1, txt(s, " inch piece of ginger")).when(n == 2, txt(s, " inch tortillas")).otherwise(txt(s, "% cream"))
    rows = table(spark, d, "part").select("p_partkey", line.alias("line")).transform(lambda r: grammar.measured(r, "line", "t", True))
    return rows.select("p_partkey", "t.value", "t.unit")


@query("""
SELECT p_partkey, 'sauce ' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'finely chopped' END AS modifier, p_partkey % 3 = 0 AS optional,
  CASE WHEN p_partkey % 5 = 0 THEN 'r' || p_partkey || '.md' END AS link, CASE WHEN p_partkey % 7 = 0 THEN 'see note' END AS annotation FROM part""")
def item_parts(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, txt("[sauce ", k, "](r", k, ".md)")).otherwise(txt("sauce ", k))
    line = F.concat(F.lit("- "), F.when(k % 7 == 0, F.lit("(see note) ")).otherwise(F.lit("")), F.col("p_size").cast("string"), F.lit(" cups "), name, F.when(k % 2 == 0, F.lit(", finely chopped")).otherwise(F.lit("")), F.when(k % 3 == 0, F.lit(" (optional)")).otherwise(F.lit("")))
    # an aside stands before the amount, so its amount is read behind it
    rows = table(spark, d, "part").select("p_partkey", line.alias("line"))
    rows = grammar.item(spread(rows, parts(rows)), "line")
    return rows.select("p_partkey", "name", "modifier", "optional", "link", "annotation")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 453.59237::DOUBLE AS a, (l_suppkey % 30 + 1) * 1000.0::DOUBLE AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(abs(a - b) / greatest(a, b), 9) AS gap FROM t WHERE abs(a - b) / greatest(a, b) > 0.1""")
def conversion_discrepancy(spark, d):
    line = txt("- ", whole("l_quantity"), " lb (", F.col("l_suppkey") % 30 + 1, " kg) stone")
    judged = lambda x, c: findings.mass_conflicts(grammar.item(x, c)).select(c, F.round("gap", 9).alias("gap"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    # lines without a conflict make no row there
    return grammar.once(rows, "line", judged).filter("gap IS NOT NULL").drop("line")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT + 100 AS c, l_suppkey % 90 + 230 AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, round(abs(c - (f - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE), 6) AS gap FROM t WHERE abs(c - (f - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE) > 5""")
def temperature_discrepancy(spark, d):
    step = txt("Bake at ", whole("l_quantity") + 100, "°C (", F.col("l_suppkey") % 90 + 230, " F) until done")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.temperatures(step).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", F.round(findings.temperature_conflict(F.col("t")), 6).alias("gap")).filter("gap IS NOT NULL")


@query("SELECT o_orderkey, ((o_orderkey % 50 + 1) * 60 + (o_custkey % 5 + 1) * 3600 + 30)::BIGINT AS seconds FROM orders")
def duration_scan(spark, d):
    step = txt("Stir ", F.col("o_orderkey") % 50 + 1, " minutes, rest ", F.col("o_custkey") % 5 + 1, " hours and 30 sec more")
    rows = table(spark, d, "orders").select("o_orderkey", T.durations(step).alias("s"))
    return rows.select("o_orderkey", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("seconds"))


@query(r"""
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (
  SELECT doc_id, unnest(CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END) AS line FROM (
    SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS s FROM documents)) GROUP BY doc_id""")
def line_explode(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(r"""
SELECT DISTINCT conv_id, turn, unicode(c)::BIGINT AS code FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\x00-\x7f]')) AS c FROM conversations) WHERE c NOT IN ('é', 'ß')""")
def non_ascii_audit(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.foreign(F.col("text"), "éß")).alias("c"))
    return rows.select("conv_id", "turn", F.ascii("c").cast("long").alias("code"))


@query("""
SELECT page_id, length(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS n_chars FROM pages""")
def comment_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.strip_comments(F.col("html"))).cast("long").alias("n_chars"))


@query("""
SELECT lang, sum(len(regexp_extract_all(text, '[º“”‘’·…]')))::BIGINT AS replaced, count(*) AS n FROM documents GROUP BY lang""")
def unicode_cleanup(spark, d):
    rows = table(spark, d, "documents").select("lang", T.odd_punctuation(F.col("text")).alias("k"), T.odd_punctuation(T.plain_punctuation(F.col("text"))).alias("left"))
    return rows.groupBy("lang").agg((F.sum("k") + F.sum("left")).alias("replaced"), F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: length(x) >= 3) AS w FROM t),
x AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM w),
b AS (SELECT DISTINCT x AS t FROM x WHERE side = 'b')
SELECT id AS doc_id, count(*) FILTER (x NOT LIKE '% %') AS n, count(t) FILTER (x NOT LIKE '% %') AS found, count(*) FILTER (x LIKE '% %') AS pairs, count(t) FILTER (x LIKE '% %') AS pairs_found
FROM x LEFT JOIN b ON b.t = x.x WHERE side = 'd' GROUP BY id""")
def coverage_vs_benchmark(spark, d):
    """Coverage of words and of pairs of words as one join: exploded words and pairs against the distinct index."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z ]", " "), " +", " "))

    def each(name: str, *keep: str) -> DataFrame:
        rows = table(spark, d, name).select(*keep, F.filter(T.tokens(plain(F.col("text"))), lambda t: F.length(t) >= 3).alias("w"))
        return rows.select(*keep, F.explode(F.concat("w", T.bigrams(F.col("w")))).alias("x"))

    docs, index = each("documents", "doc_id"), each("benchmark").distinct().withColumnRenamed("x", "t")
    pair = F.contains("x", F.lit(" "))
    out = docs.join(index, docs.x == index.t, "left").groupBy("doc_id")
    hit = F.col("t").isNotNull()
    return out.agg(F.count_if(~pair).alias("n"), F.count_if(~pair & hit).alias("found"), F.count_if(pair).alias("pairs"), F.count_if(pair & hit).alias("pairs_found"))


@query("""
WITH e AS (SELECT event_type, event_id, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM events),
r AS (SELECT event_type, event_id, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM e)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY event_type, run""")
def dropped_runs(spark, d):
    return windows.islands(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k FROM orders)
SELECT 'c' || o_custkey AS file, sum(CASE WHEN k < 2 THEN 1 ELSE 0 END)::BIGINT AS ingredients, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END)::BIGINT AS directions, sum(CASE WHEN k = 3 THEN 1 ELSE 0 END)::BIGINT AS notes FROM o GROUP BY o_custkey""")
def section_routing(spark, d):
    """A document a customer, its sections made of orders; recovered by the line classifier and the carried sections."""
    k = F.col("o_orderkey") % 4
    part = one_of(("## Ingredients\n", "## Ingredients for Glaze:\n", "## Method\n", "## Tips\n"), k)
    rows = table(spark, d, "orders").select(txt("c", F.col("o_custkey")).alias("file"), "o_orderkey", F.concat(part, F.lit("```\n# no heading\n```\n- item "), F.col("o_orderkey").cast("string"), F.lit("\n")).alias("p"))
    # orders are packed far smaller than their texts, so their number tells how many tasks gather them
    docs = spread(rows, parts(rows, GATHERED), "file").groupBy("file").agg(F.concat(F.lit("# Title\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "p"))), lambda x: x["p"]), "\n")).alias("text"))
    own = blocks.items(blocks.routed(blocks.classified(docs)))
    return own.groupBy("file").agg(*(F.count_if(F.col("section") == s).alias(s) for s in ("ingredients", "directions", "notes")))


@query("""
SELECT 'c' || c_custkey AS file, c_custkey % 3 + 1 AS records, 'Dish ' || (c_custkey % 3 + 1) AS last_title FROM customer""")
def record_split(spark, d):
    one = lambda i: F.lit(f"# Dish {i}\ntext\n\n---\n\n* * *\n\n")
    n = F.col("c_custkey") % 3
    text = F.concat(one(1), F.when(n >= 1, one(2)).otherwise(F.lit("")), F.when(n >= 2, one(3)).otherwise(F.lit("")), F.lit("end\n"))
    docs = table(spark, d, "customer").select(txt("c", F.col("c_custkey")).alias("file"), text.alias("text"))
    rows = blocks.routed(blocks.classified(docs))
    return rows.groupBy("file").agg(F.max("rec").cast("long").alias("records"), F.max_by("title", "rec").alias("last_title"))


@query("SELECT 'c' || c_custkey AS file, (c_custkey % 3)::BIGINT AS optional, (3 - c_custkey % 3)::BIGINT AS plain FROM customer")
def optional_groups(spark, d):
    n = F.col("c_custkey") % 3
    text = F.concat(F.lit("## Ingredients\n"), F.when(n == 0, "- a\n- b\n- c\n").when(n == 1, "- a\n- optional:\n  - b\n- c\n").otherwise("- a\n- Optional\n  - b\n  - c\n"))
    docs = table(spark, d, "customer").select(txt("c", F.col("c_custkey")).alias("file"), text.alias("text"))
    own = blocks.items(blocks.routed(blocks.classified(docs)))
    return own.groupBy("file").agg(F.count_if("group_optional").alias("optional"), F.count_if(~F.col("group_optional")).alias("plain"))


@query("SELECT 'c' || c_custkey AS file, CASE WHEN c_custkey % 2 = 0 THEN 'Serves ' || c_custkey END AS \"yield\" FROM customer")
def strict_yield(spark, d):
    text = F.concat(F.lit("# T\n"), F.when(F.col("c_custkey") % 2 == 0, txt("Serves ", F.col("c_custkey"))).otherwise(F.lit("Serves everybody")), F.lit("\n\n## Method\n\nMakes 4 of them\n"))
    docs = table(spark, d, "customer").select(txt("c", F.col("c_custkey")).alias("file"), text.alias("text"))
    rows = blocks.routed(blocks.classified(docs))
    return docs.select("file").join(blocks.yields(rows).select("file", "yield"), "file", "left")


@query("""
SELECT DISTINCT a.o_custkey AS file, a.o_orderpriority AS component FROM orders a WHERE a.o_orderstatus = 'O' AND NOT EXISTS (
  SELECT 1 FROM orders b WHERE b.o_orderstatus <> 'O' AND b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority)""")
def component_anti_join(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.lit(1).alias("rec"), F.when(F.col("o_orderstatus") == "O", "ingredients").otherwise("directions").alias("section"), F.col("o_orderpriority").alias("component"))
    return findings.unmatched_components(rows).select("file", "component")


def _findings(spark, d):
    e = table(spark, d, "events")
    severity = one_of(("error", "warning", "info"), F.col("user_id"))
    return e.select((F.col("user_id") % 50).alias("file"), F.col("event_type").alias("code"), F.lit("t").alias("title"), (F.col("user_id") % 7).cast("string").alias("message"), F.lit(None).cast("string").alias("context"), F.col("event_id").alias("emit_ord"), severity.alias("severity"), (F.col("event_id") % 90).alias("line"))


@query("""
SELECT user_id % 50 AS file, event_type AS code, (user_id % 7)::VARCHAR AS message, min(event_id) AS emit_ord FROM events GROUP BY ALL""")
def findings_dedup(spark, d):
    return findings.deduplicated(_findings(spark, d)).select("file", "code", "message", "emit_ord")


@query("SELECT ['error','warning','info'][user_id % 3 + 1] AS severity, count(*) AS n FROM events GROUP BY 1")
def findings_by_severity(spark, d):
    return findings.by_severity(_findings(spark, d))


@query("SELECT event_type AS code, count(*) AS n, min(event_id) AS first_ord FROM events GROUP BY 1 ORDER BY 2 DESC, 3")
def findings_by_code(spark, d):
    return _findings(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.min("emit_ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord")


@query("SELECT event_type AS code, event_id AS emit_ord, CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'warning' END AS severity FROM events WHERE user_id % 3 < 2 AND event_type = 'click'")
def findings_shown(spark, d):
    return findings.shown(_findings(spark, d), codes=["click"]).select("code", "emit_ord", "severity")


@query("""
WITH q AS (SELECT event_type, event_id, round_even(value * 100, 0)::BIGINT AS v FROM events)
SELECT event_type, event_id, v - coalesce(lag(v) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS delta, v AS back FROM q""")
def delta_roundtrip(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", catalog.quantised(F.col("value"), 100).alias("v"))
    rows = windows.with_delta(rows, ["event_type"], "event_id", "v", "delta")
    return windows.with_undelta(rows, ["event_type"], "event_id", "delta", "back").select("event_type", "event_id", "delta", "back")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def dedupe_consecutive(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return windows.without_repeats(rows, ["user_id"], [F.col("event_id")], "event_type")


@query("""
WITH p AS (SELECT c_custkey AS point, (c_custkey * 37 % 36000) / 100.0::DOUBLE AS ra, (c_custkey % 100) / 100.0::DOUBLE AS dec FROM customer),
s AS (SELECT s_suppkey AS star, (s_suppkey * 91 % 36000) / 100.0::DOUBLE AS ra, (s_suppkey % 100) / 100.0::DOUBLE AS dec FROM supplier),
x AS (SELECT point, star, sqrt(pow((((p.ra - s.ra + 180.0::DOUBLE) % 360 + 360) % 360 - 180) * cos(radians((p.dec + s.dec) / 2)), 2) + pow(p.dec - s.dec, 2)) AS sep FROM p, s),
b AS (SELECT point, arg_min(star, sep) AS star, min(sep) AS sep FROM x GROUP BY point)
SELECT point, star, round(sep, 9) AS sep FROM b WHERE sep <= 0.5""")
def nearest_snap(spark, d):
    place = lambda k, m: ((F.col(k) * m % 36000) / 100.0, (F.col(k) % 100) / 100.0)
    p, s = place("c_custkey", 37), place("s_suppkey", 91)
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point"), p[0].alias("ra"), p[1].alias("dec"))
    stars = table(spark, d, "supplier").select(F.col("s_suppkey").alias("star"), s[0].alias("ra"), s[1].alias("dec"))
    return catalog.snapped(points, stars, 0.5).select("point", "star", F.round("sep", 9).alias("sep"))


@query("""
SELECT left(sha256(unhex(string_agg(hex(path) || '00' || sha, '' ORDER BY path))), 16) AS build_id FROM (SELECT item_id::VARCHAR AS path, sha256(text) AS sha FROM benchmark)""")
def content_hash(spark, d):
    files = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return catalog.build_id(files)


@query(r"""
SELECT page_id, replace(replace(replace(url, '%', '%25'), '#', '%23'), '?', '%3F') AS escaped, CASE WHEN regexp_extract(lower(url), '\.([^./?#]+)$', 1) = 'html' THEN 'page' END AS kind FROM pages""")
def asset_paths(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_path(F.col("url")).alias("escaped"), catalog.asset_kind(F.col("url"), F.length("html")).alias("kind"))


@query("SELECT page_id, 'see <' || url || '> and [this](' || url || ').' AS text FROM pages")
def bare_url_wrap(spark, d):
    return table(spark, d, "pages").select("page_id", T.wrap_urls(txt("see ", F.col("url"), " and [this](", F.col("url"), ").")).alias("text"))


@query("SELECT p_partkey, '## ' || upper(p_name[1]) || p_name[2:] AS header FROM part")
def header_cleanup(spark, d):
    return table(spark, d, "part").select("p_partkey", T.clean_header(txt("## ", F.col("p_name"), ":")).alias("header"))


@query("SELECT c_custkey, c_acctbal / 1000 AS mag FROM customer WHERE NOT (c_acctbal = 0 AND c_custkey = 0) AND c_acctbal / 1000 <= 6.5")
def catalogue_filter(spark, d):
    stars = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("double").alias("ra"), (F.col("c_acctbal") / 1000).alias("mag"))
    return catalog.visible(stars).select("c_custkey", "mag")


@query("""
SELECT l_suppkey, list_sort(list(l_quantity))[(count(*) // 2 + 1)::BIGINT] AS median, max(l_quantity) AS worst FROM lineitem GROUP BY l_suppkey""")
def median_and_worst(spark, d):
    return catalog.medians(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


@query("""
WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS file, c_custkey % 10 = 9 AS bare, c_custkey % 7 + 1 AS lb, c_custkey % 3 + 1 AS kg, c_custkey % 90 + 110 AS c, c_custkey % 160 + 230 AS f FROM customer),
g AS (SELECT *, abs(lb * 453.59237::DOUBLE - kg * 1000.0::DOUBLE) / greatest(lb * 453.59237::DOUBLE, kg * 1000.0::DOUBLE) AS mass, abs(c - (f - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE) AS heat FROM c),
x AS (SELECT file, unnest([
  CASE WHEN bare THEN 'no-section-headings' END, CASE WHEN bare THEN 'section-inferred' END, CASE WHEN bare THEN 'section-inferred' END,
  CASE WHEN heat > 5 AND (bare OR k % 6 <> 0) THEN 'temperature-discrepancy' END, CASE WHEN NOT bare AND k % 6 = 0 THEN 'missing-directions-section' END,
  CASE WHEN NOT bare AND mass > 0.1 THEN 'conversion-discrepancy' END, CASE WHEN NOT bare AND k % 3 = 0 THEN 'component-without-directions' END,
  CASE WHEN NOT bare AND k % 2 = 0 THEN 'implicit-count-unit' END, CASE WHEN NOT bare AND k % 5 = 0 THEN 'dimension-not-quantity' END,
  CASE WHEN NOT bare AND k % 7 = 0 THEN 'quantity-unparsed' END, CASE WHEN NOT bare AND k % 4 = 0 THEN 'quantity-unparsed' END,
  CASE WHEN NOT bare AND k % 4 = 0 THEN 'ingredient-name-empty' END, CASE WHEN NOT bare AND k % 8 = 0 THEN 'non-ascii-character' END,
  CASE WHEN NOT bare AND k % 13 = 0 AND k % 11 <> 0 THEN 'yield-inferred' END, CASE WHEN NOT bare AND k % 17 = 0 THEN 'source-content-dropped' END]) AS code FROM g)
SELECT file, code, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY ALL""")
def document_findings(spark, d):
    """A document a customer, its faults chosen by the key, from text to findings."""
    k = F.col("c_custkey")
    some = lambda on, text: F.when(on, text).otherwise(F.lit(""))
    bake = txt("1. Bake at ", k % 90 + 110, "°C (", k % 160 + 230, " degrees F)\n")
    full = F.concat(
        F.lit("# T\n\n"), some(k % 11 == 0, F.lit("Serves 4\n\n")), F.lit("## Ingredients"), some(k % 3 == 0, F.lit(" for Glaze")),
        F.lit("\n\n- 2 g salt"), some(k % 8 == 0, F.lit(" ☃")), txt("\n- ", k % 7 + 1, " lb stone (", k % 3 + 1, " kg)\n"), some(k % 2 == 0, txt("- ", k % 9 + 1, " eggs\n")),
        some(k % 5 == 0, F.lit("- 9-inch pans\n")), some(k % 7 == 0, F.lit("- 7/x\n")), some(k % 4 == 0, F.lit("- 1,000g flour\n")), some(k % 6 != 0, F.concat(F.lit("\n## Method\n\n"), bake)),
        some(k % 13 == 0, F.lit("\n## Notes\n\nGives about 12 cookies\n")), some(k % 17 == 0, F.lit("\n```\nsecret lost words here\n```\n")))
    bare = F.concat(F.lit("# T\n\n- 2 cups flour\n\n"), bake)
    docs = table(spark, d, "customer").select(txt("c", k).alias("file"), F.when(k % 10 == 9, bare).otherwise(full).alias("text"))
    return documents.all_findings(docs).groupBy("file", "code").agg(F.count("*").alias("n"))


@query("""
SELECT 'p' || p_partkey AS file, CASE WHEN p_partkey % 5 < 2 THEN 'invalid-unit-class' ELSE 'invalid-nesting' END AS code, 1::BIGINT AS n FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT 'p' || p_partkey, 'implicit-count-unit', 1::BIGINT FROM part WHERE p_partkey % 5 = 4""")
def measure_findings(spark, d):
    """Items made by hand: terms of classes that are no amounts, and containers that cannot hold what they are said to."""
    k = F.col("p_partkey")
    kind = one_of(("duration", "temperature", "volume", "piece", "piece"), k)
    inner = lambda unit: F.struct(F.lit(1.0).alias("value"), F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit("x").alias("unit"), unit.alias("unit_class"))
    held = F.when(k % 5 == 2, inner(F.lit("weight"))).when(k % 5 == 3, inner(F.lit("length"))).when(k % 5 == 4, inner(F.lit("volume")))
    q = F.col("p_size").cast("double")
    term = F.struct(q.alias("value"), q.alias("lo"), q.alias("hi"), F.lit("x").alias("unit"), kind.alias("unit_class"), (k % 5 == 4).alias("implicit"), F.lit(None).cast("string").alias("fill"), held.alias("nested"))
    none = F.filter(F.array(F.struct(F.lit("").alias("text"), F.array(term).alias("terms"), F.lit(False).alias("per_unit"))), lambda _: F.lit(False))
    items = table(spark, d, "part").select(txt("p", k).alias("file"), F.lit(1).alias("rec"), F.lit("T").alias("title"), F.lit(1).alias("ln"), F.lit("x").alias("body"), F.lit("x").alias("name"), F.array(term).alias("amounts"), none.alias("alternatives"))
    found = reduce(DataFrame.unionByName, [*documents.invalid_measures(items), *documents.completeness(items)])
    return findings.deduplicated(found).groupBy("file", "code").agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, [l_quantity::BIGINT + l_linenumber / 8.0::DOUBLE, l_linenumber / 7.0::DOUBLE] AS v FROM lineitem),
s AS (SELECT *, list_transform(v, lambda x: CASE WHEN x = floor(x) THEN floor(x)::BIGINT::VARCHAR ELSE regexp_replace(CASE WHEN abs(x - round(x, 2)) < 1e-4 THEN printf('%.2f', x) ELSE printf('%.3f', x) END, '\.?0+$', '') END) AS s FROM t)
SELECT l_orderkey, l_linenumber, '- ' || s[1] || ' cups, ' || s[2] || ' or ' || q || '.5 of https://x.y/1/2 z' AS text FROM s""")
def fractions_to_decimals(spark, d):
    """Lines written with mixed, plain and vulgar fractions and an address that holds one."""
    q, n = whole("l_quantity"), F.col("l_linenumber")
    line = txt("- ", q, " ", n, "/8 cups, ", n, "/7 or ", q, "½ of https://x.y/1/2 z")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return grammar.once(rows, "line", lambda x, c: x.withColumn("text", T.decimals_for_fractions(F.col(c)))).drop("line")


@query("""
SELECT 'c' || c_custkey AS file, (c_custkey % 4)::BIGINT AS headers, (2 * (c_custkey % 4))::BIGINT AS fractions, (c_custkey % 4 + 1)::BIGINT AS punctuation, (c_custkey % 4 > 0)::INT::BIGINT AS urls FROM customer""")
def cleanup_changes(spark, d):
    """What each clean-up changes in documents whose number of faults is known; the same frontmatter in front of all."""
    part = F.lit("## note:\n- 1/2 cup\n- 3½ cups\n- none 1/2\nsee http://x.y/z. “\n")
    text = F.concat(F.lit("---\ntitle: \"a/1/2:…\"\n---\n"), F.repeat(part, F.col("c_custkey") % 4))
    docs = table(spark, d, "customer").select(txt("c", F.col("c_custkey")).alias("file"), text.alias("text"))
    each = [cleanups.cleaned(docs, rule).select("file", F.lit(rule).alias("rule"), "changes") for rule in cleanups.RULES]
    return reduce(DataFrame.unionByName, each).groupBy("file").pivot("rule", list(cleanups.RULES)).agg(F.sum("changes"))


@query("""
SELECT 'c' || c_custkey AS file, (1 + c_custkey % 3)::BIGINT AS items, (3 * (c_custkey % 3))::BIGINT AS code, (4 + c_custkey % 2)::BIGINT AS html, (c_custkey % 3 + 1)::BIGINT AS headings,
  1 AS quotes, 'first of ' || c_custkey || chr(10) || 'lazy later' AS item FROM customer""")
def block_kinds(spark, d):
    """Lines of documents with nested fences, HTML blocks, multi-line comments, quotes and items that go on: how many of each kind there are."""
    n = F.col("c_custkey") % 3
    text = F.concat(
        F.lit("A title\nof two lines\n---\n\n<!--\n## no heading\n- no item\n"), F.when(F.col("c_custkey") % 2 == 1, F.lit("more\n")).otherwise(F.lit("")), F.lit("-->\n\n"), txt("- first of ", F.col("c_custkey"), "\nlazy\n\n  later\n"), F.repeat(F.lit("-\n- again\n"), n),
        F.lit("\n> said\nhere\n\n"), F.repeat(F.lit("## part\n````\n```\n````\n"), n))
    docs = table(spark, d, "customer").select(txt("c", F.col("c_custkey")).alias("file"), text.alias("text"))
    rows = blocks.classified(docs)
    of = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy("file").agg(of("item").alias("items"), of("code").alias("code"), of("html").alias("html"), of("heading").alias("headings"), F.countDistinct(F.when(F.col("kind") == "quote", F.col("block"))).cast("int").alias("quotes"), F.min_by("body", F.when(F.col("kind") == "item", F.col("ln"))).alias("item"))


@query("""
SELECT 'p' || p_partkey AS file, CASE WHEN p_partkey % 7 = 0 THEN 'stale' WHEN p_partkey % 7 = 1 THEN 'new' ELSE 'gone' END AS state FROM part WHERE p_partkey % 7 < 3""")
def stale_files(spark, d):
    """Texts of parts against a manifest kept of them, in which some are older, some lack and some are of parts no longer there."""
    k = F.col("p_partkey")
    parts = table(spark, d, "part").select(txt("p", k).alias("file"), "p_name", k.alias("k"))
    now = files.digests(parts.filter("k % 7 <> 2").select("file", F.col("p_name").alias("text")))
    then = files.digests(parts.filter("k % 7 <> 1").select("file", F.when(F.col("k") % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("text")))
    return files.staleness(now, then)


@query("""
SELECT 'c' || c_custkey AS file, (c_custkey % 3 + 1)::BIGINT AS records, (9 + 6 * (c_custkey % 3))::BIGINT AS rows, (9 + 6 * (c_custkey % 3))::BIGINT AS same FROM customer""")
def markdown_roundtrip(spark, d):
    """Documents read, written as Markdown record by record and read again: as many rows, and all the same."""
    one = lambda i: F.lit(f"# Dish {i}\n\nSaid **so**\nand so\n\n## Method\n\n1. go\n2. on\n")
    n = F.col("c_custkey") % 3
    more = F.concat(F.lit("\n> cited\n\n| a | b |\n|---|---|\n| 1 |\n"))
    text = F.concat(one(1), more, F.when(n > 0, F.concat(F.lit("\n---\n"), one(2))).otherwise(F.lit("")), F.when(n > 1, F.concat(F.lit("\n***\n"), one(3))).otherwise(F.lit("")))
    docs = table(spark, d, "customer").select(txt("c", F.col("c_custkey")).alias("file"), text.alias("text"))
    what = lambda rows: rows.filter(~F.col("kind").isin("break", *markdown.SILENT)).groupBy("file", F.col("rec").cast("int").alias("rec"), "kind", "level", F.when(F.col("kind") == "row", F.regexp_replace("body", r"\|\s*(?=\|)|\s*\|$", "")).otherwise(F.col("body")).alias("body"), "section", "title", "ordered").agg(F.count("*").alias("n"))
    # both are read many times, and made once
    before = kept(blocks.routed(blocks.classified(docs)), "roundtrip-lines")
    text = kept(blocks.written(before).select(F.concat_ws("\t", "file", "rec").alias("file"), "text"), "roundtrip-texts")
    after = blocks.routed(blocks.classified(text))
    after = what(after.withColumn("rec", F.element_at(F.split("file", "\t"), 2)).withColumn("file", F.element_at(F.split("file", "\t"), 1)))
    first = what(before)
    keys = [c for c in first.columns if c != "n"]
    both = first.join(after.select(*(F.col(k).alias("k_" + k) for k in keys), F.col("n").alias("m")), [F.col(k).eqNullSafe(F.col("k_" + k)) for k in keys], "left")
    return both.groupBy("file").agg(F.countDistinct("rec").alias("records"), F.sum("n").alias("rows"), F.sum(F.coalesce(F.least("n", "m"), F.lit(0))).alias("same"))


@query("""
SELECT 'c' || c_custkey AS file, CASE WHEN c_custkey % 3 = 2 THEN 3 WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END::BIGINT AS spans, (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS abandoned FROM customer""")
def record_spans(spark, d):
    """Source lines by the record that they belong to; a file whose breaks and records differ in number is given up."""
    n = F.col("c_custkey") % 3
    one = lambda i: f"# Dish {i}\nwords of {i}\n\n---\n\n* * *\n\n"
    text = F.when(n == 0, F.lit("# A\nwords\n\n---\n\nB\n===\nother words\n")).otherwise(F.concat(F.lit(one(1) + one(2)), F.when(n == 2, F.lit(one(3))).otherwise(F.lit(""))))
    docs = table(spark, d, "customer").select(txt("c", F.col("c_custkey")).alias("file"), text.alias("text"))
    records = documents.structure(docs).groupBy("file").agg(F.countDistinct("rec").alias("n"))
    lines = docs.select("file", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    return documents.spans(lines, records).groupBy("file").agg(F.countDistinct("rec").alias("spans"), F.max(F.col("rec").isNull().cast("long")).alias("abandoned"))


@query(r"""
WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part),
p AS (SELECT pattern, min(ord) AS ord FROM (SELECT '*' || w[1] || '*' || w[2] || '*' AS pattern, p_partkey AS ord FROM w UNION ALL SELECT w[2], -p_partkey FROM w) GROUP BY 1),
n AS (SELECT DISTINCT p_name, translate(lower(p_name), ' -/', '___') AS k FROM part),
m AS (SELECT p_name, pattern, row_number() OVER (PARTITION BY p_name ORDER BY (k = pattern) DESC, length(replace(pattern, '*', '')) DESC, length(pattern) DESC, ord) AS best
  FROM n JOIN p ON k LIKE '%' || replace(replace(pattern, '_', '\_'), '*', '%') || '%' ESCAPE '\')
SELECT p_partkey, pattern FROM part LEFT JOIN (SELECT * FROM m WHERE best = 1) USING (p_name)""")
def pattern_index(spark, d):
    """The most specific of thousands of patterns, made of the words of all parts, for each part's name."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    w = F.split(F.lower("p_name"), " ")
    at = lambda i: F.get(w, F.lit(i))
    made = parts.select(F.concat(F.lit("*"), at(0), F.lit("*"), at(1), F.lit("*")).alias("pattern"), F.col("p_partkey").alias("ord")).unionByName(parts.select(at(1).alias("pattern"), (-F.col("p_partkey")).alias("ord")))
    patterns = made.groupBy("pattern").agg(F.min("ord").alias("ord"))
    return search.most_specific(parts, "p_name", patterns).select("p_partkey", "pattern")


@query("""
WITH l AS (SELECT lang AS file, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
n AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY doc_id, i) AS ln, line, doc_id, i FROM l),
p AS (SELECT file, doc_id AS id, substr(line, 3, 60) AS probe FROM n WHERE i = 1 AND doc_id % 20 = 0)
SELECT p.file, p.id, min(n.ln) AS ln FROM p LEFT JOIN n ON n.file = p.file AND contains(n.line, p.probe) GROUP BY ALL""")
def first_line_of_text(spark, d):
    """The first line of a language's documents, taken as one file, that holds a piece of the first line of some of them."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("file"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("x"))
    probes = docs.filter("doc_id % 20 = 0").select("file", F.col("doc_id").alias("id"), F.substring(F.get("x", F.lit(0)), 3, 60).alias("probe"))
    # texts stay where they are read: a line's place is its document and its number there, in one decimal, as sums and least values of numbers are kept hashed; only
    # of lines that are found it becomes the number in the file, behind all lines of documents before. A document without an id is the last
    at, room = F.coalesce("doc_id", F.lit(2**63 - 1)), F.lit(2**32)
    lines = docs.select("file", (at.cast("decimal(20,0)") * room).alias("at"), F.posexplode("x").alias("i", "line")).select("file", (F.col("at") + F.col("i")).alias("ln"), "line")
    found = search.first_lines(lines, probes).withColumn("i", F.pmod("ln", room)).withColumn("at", ((F.col("ln") - F.col("i")) / room).cast("long"))
    sizes = kept(docs.filter("file IS NOT NULL").groupBy("file", at.alias("at"), F.size("x").alias("n")).agg(F.count("*").alias("many")), "sizes")
    upto = windows.with_undelta(sizes.groupBy("file", "at").agg(F.sum(F.col("n") * F.col("many")).alias("all")), ["file"], "at", "all", "upto")
    # documents that share an id go on line by line, all first lines first
    own = found.select("file", "at", "i").distinct().join(sizes.hint("merge"), ["file", "at"]).groupBy("file", "at", "i").agg(F.sum(F.least("n", "i") * F.col("many")).alias("own"))
    own = own.join(upto.hint("merge"), ["file", "at"]).select("file", "at", "i", (F.col("upto") - F.col("all") + F.col("own") + 1).cast("long").alias("n"))
    return found.join(own.hint("merge"), ["file", "at", "i"], "left").select("file", "id", F.col("n").alias("ln"))


@query("""
SELECT CASE c_custkey % 9 WHEN 0 THEN 'O' WHEN 1 THEN 'O' WHEN 2 THEN 'M' WHEN 3 THEN 'G' WHEN 4 THEN 'M' ELSE 'A' END AS bucket, count(*) AS n FROM customer GROUP BY 1""")
def class_buckets(spark, d):
    kinds = one_of(("O5", "WC", "C", " g2", "M", "A", "?", "", "Q"), F.col("c_custkey"))
    return table(spark, d, "customer").select(catalog.class_bucket(kinds).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type)
SELECT user_id, event_id, event_type FROM r WHERE user_id IN (SELECT user_id FROM r GROUP BY 1 HAVING count(*) >= 5)""")
def long_polylines(spark, d):
    return windows.polylines(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], "event_type", 5)


@query("""
SELECT page_id, i AS n, i = 2 AS image, CASE i WHEN 1 THEN 'a \\[b\\]' ELSE 'pic' END AS text, CASE i WHEN 1 THEN url ELSE 'x(' || page_id || ').png "t"' END AS target FROM pages, (SELECT unnest([1, 2]) AS i)""".replace("\\\\", "\\"))
def link_parts(spark, d):
    text = txt("see [a \\[b\\]](", F.col("url"), ") and ![pic](x(", F.col("page_id"), ").png \"t\") end")
    return table(spark, d, "pages").select("page_id", F.posexplode(T.links(text)).alias("n", "l")).select("page_id", (F.col("n") + 1).alias("n"), "l.*")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::DOUBLE * 240 * 0.91::DOUBLE WHEN 1 THEN l_quantity::DOUBLE * 53.5 WHEN 2 THEN l_quantity::DOUBLE * 1000 END AS value,
  CASE l_linenumber % 4 WHEN 1 THEN l_quantity::DOUBLE * 44 END AS value_min, CASE l_linenumber % 4 WHEN 1 THEN l_quantity::DOUBLE * 63 END AS value_max,
  CASE l_linenumber % 4 WHEN 0 THEN 'Volume conversion factor: 240.0ml/cup, Density for pattern ''olive_oil'': 0.91g/ml' WHEN 1 THEN 'Piece weight for pattern ''*egg*'': 44-63g each' WHEN 2 THEN 'Weight conversion factor: 1000.0g/kilogram'
    ELSE '''can'' is a container unit; its weight depends on the contents (unknown)' END AS details
FROM lineitem""")
def weight_explained(spark, d):
    k = F.col("l_linenumber")
    at = lambda *v: one_of(v, k)
    found = units.weight_details(F.col("l_quantity").cast("double"), at("cup", "count", "kilogram", "can"), at("volume", "piece", "weight", "piece"), at("olive oil", "Egg", "egg", "beans"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", found.alias("x")).select("l_orderkey", "l_linenumber", "x.value", "x.value_min", "x.value_max", "x.details")
