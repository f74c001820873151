"""Registered queries of the operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import exact, html, langid, minhash, quality, repair, rules, substring, toxicity, trie, urls
from feedloom.llm.bpe import bpe_digests
from feedloom.llm.common import documents
from feedloom.llm.packing import pack_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


@query("op10_bpe_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


@query("op4_exact_dedup", exact.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir), digest=True)


@query("op9_quality_rules", rules.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rules.rule_quality(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_substring_dedup", substring.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.duplicate_words(documents(spark, sf_dir))


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(documents(spark, sf_dir), size=4)


@query("op3_quality_ranking")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op6_url_filters", urls.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.judge(urls.page_captures(pages), urls.page_entries(pages))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op13_conversation_trie", trie.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
