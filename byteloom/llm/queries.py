"""The queries of this subpackage, over whole tables and with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from byteloom.llm import chat_format, embedding_dedup, packing, quality, sentencepiece_codec, simhash, suffix_dedup, token_counts, toxicity, url_filter
from byteloom.llm.common import small_batches, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.prefix_table(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("k")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_documents(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars")


def _in_small_batches(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_token_counts, op2_suffix_dedup, op3_embedding_dedup, op4_chat_format, op5_sentencepiece, op6_toxicity, op7_best_fit_packing, op8_url_filter, op9_simhash, op10_quality_rules)
    return {f.__name__: _in_small_batches(f) for f in all_}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_dedup": embedding_dedup.SQL,
        "op4_chat_format": chat_format.SQL,
        "op8_url_filter": url_filter.sql(),
        "op10_quality_rules": f"select doc_id, lang, source, n_chars from (select *, text as t from documents) where {quality.accepted_sql()}",
    }
