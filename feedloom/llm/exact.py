"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

The first scan reads each length and a short prefix.  Only groups that agree on both go on: the
second scan hashes the whole text of their rows alone.  Lower-casing A-Z keeps the byte length,
so the length needs no normalised text.  SQL functions only; texts are never shuffled while the
surviving (length, prefix) keys pass a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import by_key, id_text, unused
from feedloom.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 64
#: Up to this many rows (some 64 bytes each in a hash table) a checked side is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a staged table, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The copy group of every row: ``doc_id, keep_id, group_size, kept`` (and ``text_sha256`` if asked for).

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.  Null
    text: equal to the empty text.  Rows that repeat both id and text are one document: each has
    ``kept`` true and each counts in ``group_size``.  Null id: its row goes if its group has an id,
    else it stays.  Empty table: no rows.
    """
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", F.octet_length("text").alias("len"), F.xxhash64(ascii_lower(F.substring("text", 1, PREFIX))).alias("prefix"))
    first = stage(rows.select("len", "prefix"), "exactfirst")
    # rows of a hot length stay where they are and are counted there by prefix before they move
    lengths = stage(first.groupBy("len").count().where("count > 1").select("len"), "exactlengths")
    keys = stage(first.join(if_small(lengths), "len", "left_semi").groupBy("len", "prefix").count().where("count > 1").select(F.col("len").alias("k_len"), F.col("prefix").alias("k_prefix"), F.lit(True).alias("again")), "exactkeys")
    joined = rows.join(if_small(keys), (F.col("len") == F.col("k_len")) & (F.col("prefix") == F.col("k_prefix")), "left")
    sha = F.sha2(ascii_lower("text"), 256)
    out = [F.col("doc_id"), F.when(F.col("again"), sha).alias("full")] + ([sha.alias("text_sha256")] if digest else [])
    second = stage(joined.select(*out), "exactsecond")
    extra = ["text_sha256"] if digest else []
    alone = second.where("full IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *extra)
    rest = second.where("full IS NOT NULL")
    # staged, so that both sides of the join are plain exchanges and Spark can split a hot group
    groups = stage(rest.groupBy("full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exactcopies")
    found = alone.unionByName(rest.join(groups, "full").select("doc_id", "keep_id", "group_size", *extra))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text one stays."""
    found = stage(exact_groups(docs, id_col, text_col), "exactgroups")
    gone = stage(found.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct(), "exactgone")
    twice = stage(found.where("kept AND group_size > 1").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col)), "exacttwice")
    # an id may both go and stay when rows of different text share it: then texts decide
    mixed = stage(by_key(gone, found.where("kept").select(F.col("doc_id").alias(id_col)), [id_col], "left_semi").unionByName(twice).distinct(), "exactmixed")
    kept = by_key(by_key(docs, if_small(gone), [id_col], "left_anti"), if_small(mixed), [id_col], "left_anti")
    if mixed.isEmpty():
        return kept
    digest, keep = unused(docs, "__t", "__keep")
    again = by_key(docs, if_small(mixed), [id_col], "left_semi").withColumn(digest, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    best = docs.groupBy(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256).alias(digest)).agg(F.max(id_col).alias(keep))
    again = again.join(best, digest).where(F.col(id_col).eqNullSafe(F.col(keep))).dropDuplicates([id_col, digest])
    return kept.unionByName(again.select(*docs.columns))


SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""
