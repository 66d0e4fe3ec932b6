"""Times the headline queries once each in a warm session and prints one line of JSON.

As the reference does, searches look up an index that is built once; ``index_corpus`` is the time of that. The index holds
conversations and documents, each document as one section. Queries without ``saved_`` read the tables themselves.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera import queries

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "saved_boolean_search", "saved_regex_search", "saved_fuzzy_search", "saved_stem_search", "saved_search_sections", "saved_bm25_search", "saved_match_context", "saved_assemble_context",
    "token_counts", "extract_sections", "document_stats", "apply_changes", "bm25_postings", "vector_search", "exact_duplicates", "corpus_stats", "backlinks",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        # partitions of few bytes can hold much work here, so they aren't merged into one
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        took[name] = round(time.time() - start, 3)

    spark.range(1000).repartition(4).selectExpr("count(DISTINCT id % 7)").collect()  # the session is warm
    timed("index_corpus", lambda: queries.saved(spark, FOLDER))
    for name in HEADLINE:
        timed(name, lambda name=name: queries.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save())
    sections = queries.saved(spark, FOLDER)["sections"].count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": FOLDER.rsplit("sf", 1)[-1], "sections": sections, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
