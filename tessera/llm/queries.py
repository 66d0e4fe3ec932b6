"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, conversation_trie, decontaminate, fill_in_middle, order_minhash, packing, parity_join, quality_model, quality_rules, suffix_dedup, token_count, toxicity, url_filter
from tessera.llm.common import table
from tessera.llm.sql import SQL  # noqa: F401 (with the queries)


def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """The packing of production: documents end with id 1; the special string has its id in the vocabulary."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.col("leaked_items.item_id").alias("item_ids"), F.round(F.array_max("leaked_items.similarity"), 9).alias("similarity"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join_similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality_model": op6_quality_model,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_parity_join": op9_parity_join,
    "op10_token_count": op10_token_count,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fingerprints": op13_fingerprints,
}
