"""The corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing.

Every stage reads the documents that its predecessor wrote and returns the columns of ``documents``;
the last returns the pieces with their sequences.

Null text counts as empty everywhere: the quality rules reject it, as they do a text of any kind that
has too few words.  Rows with a null id stay documents of their own.  Rows that repeat id and text share
their fate; exact dedup keeps one of them.  Columns besides id and text may be called anything and
travel along.  Empty table: no rows after any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import by_key, documents, unused
from feedloom.llm.exact import drop_copies, if_small
from feedloom.llm.minhash import near_classes
from feedloom.llm.packing import pack_documents
from feedloom.llm.rules import rule_quality
from feedloom.llm.substring import without_duplicates
from feedloom.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; a document is an id with its text."""
    key, *pair = unused(docs, "__key", "__d", "__k")
    marked = docs.withColumn(key, F.struct(F.col("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")))
    judged = rule_quality(marked, key, "text")
    rejected = stage(judged.where(~F.col("kept")).select(F.col("doc_id.d").alias(pair[0]), F.col("doc_id.k").alias(pair[1])).distinct(), "rejected")
    keyed = docs.withColumns({pair[0]: F.col("doc_id"), pair[1]: F.xxhash64(F.coalesce("text", F.lit("")))})
    return by_key(keyed, if_small(rejected), pair, "left_anti").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the one with the largest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class at five-word shingles and similarity 0.8 the document with the smallest id stays."""
    classes = stage(near_classes(docs).select("doc_id", "kept"), "nearclasses")
    gone = stage(by_key(classes.where("NOT kept").select("doc_id").distinct(), classes.where("kept"), ["doc_id"], "left_anti"), "neargone")
    return by_key(docs, if_small(gone), ["doc_id"], "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that also start earlier go; a document left without words stays as an empty text."""
    left = without_duplicates(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens and the sequences they are packed into."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The packing stage needs a tokenizer, which SQL does not have; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
