"""A corpus made ready for training: five stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import bpe, jaccard, mixing, pii, toxicity
from tamis.llm.common import keep
from tamis.llm.queries import CATEGORIES, RANKS, toxicity_labels


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.clean(docs, toxicity_labels(spark, sf_dir), CATEGORIES)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays; of five-word shingles at least four fifths are shared. Of rows
    that repeat an id the one of the least hash stays, rows without one stay."""
    classes = jaccard.classes(docs, k=5, num=4, den=5)
    kept = classes.filter("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("x")).select("x.*")
    return one.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are generalised inside the texts; n_chars follows."""
    out = pii.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True))


STAGES = [("toxicity", without_toxic), ("near duplicates", without_near_duplicates), ("personal data", without_personal_data), ("mix", mixed), ("tokens", encoded)]
#: Learned models, components and a byte-level tokenizer: not for SQL. tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
