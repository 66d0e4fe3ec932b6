"""From raw documents to packed training sequences.

Each stage takes all that its predecessor kept: quality rules reject documents, of each group of near copies one stays,
repeated passages go, documents with benchmark items go, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, parity_join, quality_rules, suffix_dedup
from tessera.llm.common import discard_but, own_tables, table, written
from tessera.llm.queries import packed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("suffix_array_dedup", repeated_passages), ("benchmark_decontamination", benchmark_leaks), ("packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what each keeps is written before the next reads it, and tables that are
    read no more are deleted."""
    docs = table(spark, sf_dir, "documents")
    with own_tables() as mine:
        for _, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir))
            discard_but(docs, mine)
        return STAGES[-1][1](spark, docs, sf_dir)
