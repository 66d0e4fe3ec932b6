"""Duplicate sections: exact, near, and collapsed in results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.patterns import path_matches
from tessera.sources.scratch import stored

#: The shortest content that counts, locations told of a group, and the similarity of near duplicates.
MIN_LENGTH, MAX_LOCATIONS, SIMILAR = 50, 3, 0.85
MEMBER = ("path", "start_line", "section_id", "heading")
#: Vectors of a block at least and at most, and blocks where a table has enough vectors for so many but not for more.
BLOCK, MOST_OF_BLOCK, BLOCKS = 1024, 65_536, 12
#: Rows of each side that are multiplied at once.
SIDE = 1024


def hashed(sections: DataFrame, min_length: int = MIN_LENGTH, path: str | None = None) -> DataFrame:
    """Sections long enough (before normalization), with the hash of their normalized content."""
    some = sections.filter(F.length("content") >= min_length)
    some = some if path is None else some.filter(path_matches(F.col("path"), path))
    return some.withColumn("hash", F.sha2(tx.normalized(F.col("content")), 256))


def exact_duplicates(sections: DataFrame, min_length: int = MIN_LENGTH, path: str | None = None) -> DataFrame:
    """(hash, size, primary, duplicates) of groups of equal sections; primary is the first by (path, start_line).

    duplicates lists all others in order, an array in one row; duplicate_members() has them as rows, which a group of
    any size allows.
    """
    rows = duplicate_members(sections, min_length, path)
    where = F.struct(*MEMBER)
    out = rows.groupBy("hash", "size").agg(F.min(F.when(F.col("place") == 1, where)).alias("primary"), F.sort_array(F.collect_list(F.when(F.col("place") > 1, where))).alias("duplicates"))
    return out.select("hash", "size", "primary", "duplicates")


def duplicate_members(sections: DataFrame, min_length: int = MIN_LENGTH, path: str | None = None) -> DataFrame:
    """A row for every section of a group: hash, size, place in it, and where it is.

    Hashes and places are stored once, without texts. The members of groups are then sorted over all tasks, so a group of
    any size is dealt to several; a member's place is its place in its task and those of earlier tasks.
    """
    rows = stored(hashed(sections, min_length, path).select("hash", *MEMBER))
    sizes = rows.groupBy("hash").agg(F.count("*").alias("size")).filter("size > 1")
    # the number of a row holds that of its partition in the bits from the 33rd
    ordered = stored(rows.join(sizes, "hash").orderBy("hash", *MEMBER).withColumn("i", F.monotonically_increasing_id())).withColumn("part", F.shiftright("i", 33))
    parts = ordered.groupBy("hash", "part").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("hash", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return ordered.join(starts, ["hash", "part"]).select("hash", *MEMBER, "size", (F.col("i") + F.col("shift")).cast("int").alias("place"))


def duplicate_summary(sections: DataFrame, min_length: int = MIN_LENGTH, path: str | None = None) -> DataFrame:
    """One row: sections analyzed, groups, pairs (size - 1 of each group) and sections involved."""
    sizes = hashed(sections, min_length, path).groupBy("hash").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.agg(zero(F.sum("size")).alias("analyzed"), F.count_if(F.col("size") > 1).alias("groups"), zero(F.sum(F.when(F.col("size") > 1, F.col("size") - 1))).alias("pairs"), zero(F.sum(F.when(F.col("size") > 1, F.col("size")))).alias("involved"))


def collapse(results: DataFrame, sections: DataFrame, max_locations: int = MAX_LOCATIONS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Results (query_id, section_id, rank) with one of each group of duplicates, the best ranked, its number of
    duplicates and where the first of them are."""
    own = duplicate_members(sections, min_length).select("section_id", "hash", "size", F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("at"), "place")
    heads = own.filter(F.col("place") <= max_locations + 1).groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("place", "at", "section_id"))).alias("places"))
    known = results.join(own.select("section_id", "hash", "size"), "section_id", "left").withColumn("hash", F.coalesce("hash", "section_id"))
    first = known.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "hash").orderBy("rank"))).filter("k = 1").drop("k")
    others = F.transform(F.filter("places", lambda p: p["section_id"] != F.col("section_id")), lambda p: p["at"])
    out = first.join(heads, "hash", "left").withColumn("locations", F.coalesce(F.slice(others, 1, max_locations), F.array().cast("array<string>")))
    return out.withColumn("duplicate_count", F.coalesce(F.col("size") - 1, F.lit(0))).drop("hash", "size", "places")


def vector_classes(vectors: DataFrame) -> DataFrame:
    """A row for every vector: section_id, class_id (the smallest id of the vectors equal to it) and size of the class.
    Rows without a vector have no class."""
    some = vectors.filter(F.col("embedding").isNotNull()).select("section_id", "embedding")
    classes = some.groupBy("embedding").agg(F.min("section_id").alias("class_id"), F.count("*").alias("size"))
    return some.join(classes, "embedding").select("section_id", "class_id", "size")


def near_duplicates(vectors: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of vectors whose cosine is at least the threshold, a < b. Equal vectors meet as one, by their
    smallest id; vector_classes() has who they are. Zero vectors and ones of another dimension have no similarity.

    Exact: vectors are dealt into blocks, and each two blocks are multiplied in one task, so all tasks are alike. A vector is
    shuffled once for each block; these are ``BLOCKS`` until a block has ``MOST_OF_BLOCK`` vectors, so what is shuffled grows
    with the table, and a task holds two blocks and a tile of products.
    """
    some = vectors.filter(F.col("embedding").isNotNull())
    once = some.groupBy("embedding").agg(F.min("section_id").alias("section_id"))
    n = vectors.count()
    blocks = max(1, min(BLOCKS, -(-n // BLOCK)), -(-n // MOST_OF_BLOCK))
    own, other = F.pmod(F.xxhash64("section_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = once.withColumn("own", own).select("section_id", "embedding", "own", other)
    dealt = dealt.select("section_id", "embedding", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = vectors.schema["section_id"].dataType.simpleString()
    return dealt.groupBy("i", "j").applyInPandas(_near(threshold), f"a {kind}, b {kind}, similarity double")


def _near(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def near(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iat[0], rows["j"].iat[0]
        found = [pd.DataFrame({"a": rows["section_id"].iloc[:0], "b": rows["section_id"].iloc[:0], "similarity": np.zeros(0)})]
        for _, same in rows.groupby(rows["embedding"].map(len)):
            m = np.stack(same["embedding"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1) if m.shape[1] else np.zeros(len(m))
            ids, own, m = same["section_id"].to_numpy()[norm > 0], same["own"].to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for k in range(0, len(left), SIDE):
                for l in range(0, len(right), SIDE):
                    some, others = left[k : k + SIDE], right[l : l + SIDE]
                    sims = m[some] @ m[others].T
                    x, y = np.nonzero(sims >= threshold - 1e-12)
                    p, q, sims = ids[some[x]], ids[others[y]], sims[x, y]
                    kept = p < q if i == j else np.ones(len(p), bool)
                    if kept.any():
                        found.append(pd.DataFrame({"a": np.where(p < q, p, q)[kept], "b": np.where(p < q, q, p)[kept], "similarity": sims[kept]}))
        return pd.concat(found)

    return near
