"""A trigram index of sections: boolean and regex searches read the texts of candidates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.trigrams import Formula, grams, holds

#: Candidates that are looked up by a filter that reaches the scan.
MOST_LOOKED_UP = 500


def trigram_rows(sections: DataFrame, text: str = "content", key: str = "section_id") -> DataFrame:
    """(gram, key): the distinct three-letter strings of each text in lower case; a null or short text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1))
    return sections.select(F.explode(F.array_distinct(found)).alias("gram"), key)


def index_trigrams(sections: DataFrame, folder: str) -> DataFrame:
    """Write the trigrams of sections and return them. Each file has those of its own sections in order of the gram alone
    (sorting ids too took twice the time), so that nothing is shuffled and a search reads the pages of its own grams."""
    rows = trigram_rows(sections).sortWithinPartitions("gram")
    rows.write.option("compression", "zstd").parquet(f"{folder}/trigrams.parquet")
    return sections.sparkSession.read.schema(rows.schema).parquet(f"{folder}/trigrams.parquet")


def candidates(trigrams: DataFrame, formula: Formula, key: str = "section_id") -> DataFrame | None:
    """(key): the texts that satisfy a formula; none (instead of a table) if every text may."""
    wanted = grams(formula)
    if not wanted:
        return None
    have = trigrams.filter(F.col("gram").isin(wanted)).groupBy(key).agg(F.collect_set("gram").alias("have"))  # grams of the query at most
    return have.filter(holds(F.col("have"), formula)).select(key)


def narrowed(sections: DataFrame, trigrams: DataFrame | None, formula: Formula, key: str = "section_id") -> DataFrame:
    """The sections that a formula doesn't rule out."""
    found = candidates(trigrams, formula, key) if trigrams is not None else None
    if found is None:
        return sections
    few = [r[0] for r in found.limit(MOST_LOOKED_UP + 1).collect()]
    if len(few) <= MOST_LOOKED_UP:
        return sections.filter(F.col(key).isin(few)) if few else sections.limit(0)
    return sections.join(found, key, "left_semi")
