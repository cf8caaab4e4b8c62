"""The registered queries of this package: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import ann, bpe, chat, jaccard, licenses, lm, mixing, packing, pii, quality, repair, toxicity, whitening
from tamis.llm.common import table

#: The vocabulary of the production query; a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The vocabulary that documents are packed with, and the same as ranks.
PACKED, PACKED_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a tree: source/lang/doc_id.txt; every twentieth is a licence file of that folder by its name, every sixtieth one of
    source, so that documents without a licence of their own inherit from the nearest of them that tells one."""
    docs = table(spark, sf_dir, "documents")
    place = F.when(F.col("doc_id") % 60 != 0, F.coalesce("lang", F.lit("_"))).when(F.col("doc_id").isNull(), F.coalesce("lang", F.lit("_")))
    name = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), place, name)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.expand(turns))


#: The chain of the production query: whether a text is of low quality, then whether it is toxic.
CATEGORIES = ("low_quality", "toxic")


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), toxicity_labels(spark, sf_dir), CATEGORIES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.systematic(sized)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with faults put in, repaired. A conversation that lost all its rows is still told."""
    turns = table(spark, sf_dir, "conversations")
    return repair.digests(repair.repair(repair.damage(turns), turns))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKED), ranks=public_tokenizers.path(PACKED_RANKS)))


_ALL = (
    op1_license_scan, op2_chat_formatting, op3_toxicity, op4_quality_rules, op5_context_tree, op6_mixing, op7_jaccard_join, op8_pii,
    op9_additive_quantisation, op10_byte_bpe, op11_conversation_repair, op12_embedding_whitening, op13_packing,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = "[^ \\t\\n\\x0B\\f\\r]+"

ORACLES = {
    "op2_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, length('### ') + length(role) + len(regexp_extract_all(role || ' ', '#\\*## ')) + len(regexp_extract_all(role, '<\\*/turn>')) + len(regexp_extract_all(role, ':\\* ')) + 2
    + length(text) + len(regexp_extract_all(text || ' ', '#\\*## ')) + len(regexp_extract_all(text, '<\\*/turn>')) + 9 AS n FROM t),
w AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM p)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id""",
    "op6_mixing": f"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS size FROM documents),
s AS (
  SELECT doc_id, min(source) AS source, sum(size)::BIGINT AS size, md5('17/' || coalesce(doc_id::VARCHAR, chr(0) || 'null')) AS h FROM r GROUP BY doc_id),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
b AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM a),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM b),
d AS (
  SELECT *, row_number() OVER o AS k,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
e AS (SELECT min(k) AS k0, arg_min(level, k) AS level0 FROM d WHERE level <= ratio),
f AS (
  SELECT source, source_size, CASE WHEN k >= k0 THEN least(cap, level0 * w) ELSE cap END AS target,
    ('0x' || substr(md5('17/' || coalesce(source, chr(0) || 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d LEFT JOIN e ON true),
g AS (
  SELECT s.doc_id, s.size, f.source_size, f.target, f.u, CASE WHEN f.source_size > 0 THEN least(f.target / f.source_size, 2.0::DOUBLE) ELSE 0 END AS e,
    (row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.h, s.doc_id) - 1)::DOUBLE AS r
  FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * (floor(e * (r + 1) + u) - floor(e * r + u)))::BIGINT AS taken FROM g""",
    "op11_conversation_repair": r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(key))), lambda c, i:
    xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(key[i // 8 + 1])) ELSE c END) >> 1, 3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, ascii(key[i // 8 + 1])) ELSE c END) & 1))), 4294967295) % 20 AS m FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE m <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 24), md5(text), copy) AS i FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS rep FROM o),
f AS (
  SELECT *, left(role, 1) AS cls, CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 1 WHEN rep > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*$') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM q),
s(st, mid, letters, price, said) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 3, ['user:']), (1, 3, 'II', 6, ['user:', 'assistant:']),
    (2, 2, '', 0, []), (2, 3, 'I', 3, ['assistant:']), (2, 2, 'II', 6, ['assistant:', 'user:']), (3, 3, '', 0, []), (3, 2, 'I', 3, ['user:']), (3, 3, 'II', 6, ['user:', 'assistant:'])),
e(mid, edit, cls, nxt, price, named) AS (
  VALUES (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL),
    (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (3, 'R', NULL, 2, 3, 'user'), (2, 'R', NULL, 3, 3, 'assistant')),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS st, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM conversations
  UNION ALL
  SELECT conv_id, i, st, cost, audit, said FROM (
    SELECT w.conv_id, f.i, e.nxt AS st, w.cost + s.price + e.price + CASE WHEN f.fault = 3 AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || s.letters || e.edit AS audit,
      list_concat(w.said, s.said, CASE WHEN e.edit = 'D' THEN []::VARCHAR[] ELSE [coalesce(e.named, f.role) || ':' || f.text] END) AS said,
      row_number() OVER (PARTITION BY w.conv_id, e.nxt ORDER BY w.cost + s.price + e.price + CASE WHEN f.fault = 3 AND e.edit <> 'D' THEN 3 ELSE 0 END, w.audit || s.letters || e.edit) AS best
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN s ON s.st = w.st JOIN e ON e.mid = s.mid AND (e.cls IS NULL OR e.cls = f.cls) AND (e.edit = 'D' OR f.fault NOT IN (1, 2)))
  WHERE best = 1),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before || cls NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
t AS (
  SELECT w.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
    w.cost + CASE w.st WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, w.audit || CASE w.st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(w.said, CASE w.st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END) AS said
  FROM w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n.n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM t) WHERE best = 1""",
}
