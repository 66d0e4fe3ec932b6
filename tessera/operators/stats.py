"""Numbers about a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: documents, total, mean, least, most and (upper) median tokens, and sections. Documents and tokens of an
    empty corpus are 0."""
    own = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.round(F.avg("token_count")).cast("long").alias("mean_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY token_count DESC)").alias("median_tokens"))
    return own.crossJoin(F.broadcast(sections.agg(F.count("*").alias("sections"))))


def sections_by_level(sections: DataFrame) -> DataFrame:
    return sections.groupBy("level").agg(F.count("*").alias("sections"))


def line_counts(docs: DataFrame) -> DataFrame:
    """(path, lines), longest first."""
    return docs.select("path", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines")).orderBy(F.desc("lines"), "path")


def outline(sections: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Headings in order with depth, span, tokens and flags."""
    own = sections if paths is None else sections.join(paths.select("path").distinct(), "path", "left_semi")
    depth = F.size(F.split("number", r"\.")) - 1
    return own.select("path", "ordinal", depth.alias("depth"), "number", "level", "heading", "start_line", "end_line", "token_count", "has_code", "has_list", "has_table").orderBy("path", "ordinal")
