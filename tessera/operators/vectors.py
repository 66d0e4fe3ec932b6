"""Vector search: exact, boosts, fusion with keyword ranks, re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.bm25 import bm25_search, top
from tessera.plans.patterns import path_matches

if TYPE_CHECKING:
    from tessera.operators.vector_index import VectorIndex

#: The default similarity threshold, over-fetch and RRF constant.
THRESHOLD, OVERFETCH, RRF_K = 0.35, 2, 60
#: Queries that are broadcast at once; a longer table goes in blocks, or is joined.
MOST_QUERIES = 4096
#: Products that a task holds at once, and candidates that it gathers before it keeps the best alone.
TILE, HELD = 1 << 20, 1 << 18


def nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, section_id, similarity, rank) of the ``limit`` nearest by cosine, exactly; ties by section_id.

    Vectors are dealt over all cores. Each task multiplies its vectors with a block of queries, ``TILE`` products at a time,
    and keeps the best of each query, so what is shuffled is the vectors and cores x queries x limit rows. Zero vectors and
    ones of another dimension have no similarity.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, section_id {vectors.schema['section_id'].dataType.simpleString()}, similarity double"
    asked, parts = queries.select("query_id", "embedding"), []
    blocks = -(-asked.count() // MOST_QUERIES)
    dealt = vectors.select("section_id", "embedding").repartition(vectors.sparkSession.sparkContext.defaultParallelism, "section_id")
    for k in range(blocks):  # by hash, so that a block has about MOST_QUERIES rows and the driver one block at a time
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).orderBy("query_id").collect()
        shared = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in block], [np.asarray(r["embedding"] or [], np.float64) for r in block]))
        parts.append(dealt.mapInPandas(_scored(shared, k=limit), kinds))
    if not parts:
        return vectors.sparkSession.createDataFrame([], kinds + ", rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, limit, "similarity")


def unit_rows(series: pd.Series, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the vectors of ``dims`` dimensions that have a direction stand, and these as rows of length 1."""
    at = np.flatnonzero(series.map(lambda v: v is not None and len(v) == dims))
    if len(at):
        rows = np.stack(series.to_numpy()[at]).astype(np.float64)
        norm = np.linalg.norm(rows, axis=1)
        at, rows, norm = at[norm > 0], rows[norm > 0], norm[norm > 0]
        if len(at):
            yield at, rows / norm[:, None]


class Best:
    """The ``limit`` best rows of each of some queries, in arrays; of equal similarities (to nine digits) the smaller ids.

    What is held at once is a tile of products, the best so far, and ``HELD`` candidates more.
    """

    def __init__(self, queries: int, limit: int):
        self.limit = limit
        self.least = np.full(queries, -np.inf)  # what a row must have at least, once a query has ``limit`` rows
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # queries, ids and similarities of candidates
        self.waiting = 0  # candidates since the best were told apart

    def compare(self, asks: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> None:
        """Rows of length 1 against queries of length 1 (those that ``asks`` names), a tile at a time."""
        step = max(1, TILE // len(queries))
        for k in range(0, len(rows), step):
            self.add(asks, ids[k : k + step], rows[k : k + step] @ queries.T)

    def add(self, asks: np.ndarray, ids: np.ndarray, similarity: np.ndarray) -> None:
        """Rows (ids) by queries (asks)."""
        least = self.least[asks]
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and len(ids) >= self.limit:  # the first rows of a query tell what others must have
            some = similarity[:, new]
            some = np.where(np.isnan(some), -np.inf, some)
            least[new] = np.round(np.partition(some, -self.limit, axis=0)[-self.limit], 9)
            self.least[asks] = least
        at, j = np.nonzero(similarity >= least - 1e-9)
        if len(at):
            self.held.append((asks[j], ids[at], np.round(similarity[at, j], 12)))
            self.waiting += len(at)
            if self.waiting > HELD:
                self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        asks, ids, similarity = (np.concatenate(x) for x in zip(*self.held))
        key = np.round(similarity, 9)
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -key, asks))
        asks, ids, similarity, key = asks[order], ids[order], similarity[order], key[order]
        place = np.arange(len(asks)) - np.searchsorted(asks, asks)
        last = place == self.limit - 1
        self.least[asks[last]] = key[last]
        best = place < self.limit
        self.held, self.waiting = [(asks[best], ids[best], similarity[best])], 0

    def frame(self, ids: list) -> pd.DataFrame:
        """The best of all queries: query_id, section_id, similarity."""
        self._settle()
        asks, names, values = self.held[0] if self.held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"query_id": pd.Series(ids).iloc[asks].to_numpy(), "section_id": names, "similarity": values})

    def rows(self, ids: list) -> Iterator[pd.DataFrame]:
        for _, own in self.frame(ids).groupby("query_id", sort=False):
            yield own


def _scored(shared, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        asked = pd.Series(vectors)
        sides = {d: next(unit_rows(asked, d), None) for d in set(map(len, vectors)) - {0}}
        best = Best(len(ids), k)
        for batch in batches:
            for d, side in sides.items():
                if side:
                    for at, rows in unit_rows(batch["embedding"], d):
                        best.compare(side[0], batch["section_id"].to_numpy()[at], rows, side[1])
        yield best.frame(ids)

    return scored


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """The ``limit`` nearest of each query, less those under the threshold."""
    return nearest(vectors, queries, limit).filter(F.round("similarity", 9) >= threshold)


def vector_search_stats(vectors: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, below, highest, suggested): what of the nearest missed the threshold, and a threshold that helps."""
    missed = F.round("similarity", 9) < threshold
    out = nearest(vectors, queries, limit).groupBy("query_id").agg(F.count_if(missed).alias("below"), F.max(F.when(missed, F.col("similarity"))).alias("highest"))
    return out.withColumn("suggested", F.greatest(F.lit(0.1), F.col("highest") - 0.05))


def rerank_boosted(results: DataFrame, queries: DataFrame, limit: int, path: str | None = None) -> DataFrame:
    """Results (query_id, section_id, path, heading, similarity) with boosts for headings and important files, sorted
    anew: boosted (at most 1), rank, and available (how many there were). A path glob drops results first."""
    out = results if path is None else results.filter(path_matches(F.col("path"), path))
    texts = queries.select("query_id", "query")
    out = out.drop("rank").join(F.broadcast(texts) if queries.count() <= MOST_QUERIES else texts, "query_id")
    out = out.withColumn("boosted", F.least(F.lit(1.0), F.col("similarity") + tx.heading_boost(F.col("heading"), F.col("query")) + tx.file_boost(F.col("path"))))
    out = out.withColumn("available", F.count("*").over(Window.partitionBy("query_id")))
    return top(out, limit, "boosted").drop("query")


def semantic_search(vectors: DataFrame | VectorIndex, queries: DataFrame, limit: int = 10, threshold: float = THRESHOLD, path: str | None = None, filter_mode: str = "pre", quality: str = "balanced") -> DataFrame:
    """Nearest sections (twice as many as asked for), threshold, path filter, boosts, limit. The path filter is applied
    before the search unless ``filter_mode`` is "post". A table is searched exactly, an index in the mode ``quality``."""
    table = vectors if isinstance(vectors, DataFrame) else vectors.vectors
    pool = table if path is None or filter_mode == "post" else table.filter(path_matches(F.col("path"), path))
    if isinstance(vectors, DataFrame):
        near = nearest(pool, queries, limit * OVERFETCH)
    else:
        near = replace(vectors, vectors=pool).nearest(queries, limit * OVERFETCH, quality)
    near = near.filter(F.round("similarity", 9) >= threshold)
    known = near.join(pool.select("section_id", "path", "heading"), "section_id")
    return rerank_boosted(known, queries, limit, path if filter_mode == "post" else None)


def rrf(semantic: DataFrame, keyword: DataFrame, w_semantic: float = 1.0, w_keyword: float = 1.0, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (query_id, section_id, score, rank, sources)."""
    s = semantic.select("query_id", "section_id", F.col("rank").alias("rs"))
    b = keyword.select("query_id", "section_id", F.col("rank").alias("rk"))
    both = s.join(b, ["query_id", "section_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", part(w_semantic, "rs") + part(w_keyword, "rk"))
    both = both.withColumn("sources", F.array_compact(F.array(F.when(F.col("rs").isNotNull(), "semantic"), F.when(F.col("rk").isNotNull(), "keyword"))))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("rs"), F.asc_nulls_last("rk"), "section_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "section_id", "score", "rank", "sources")


def hybrid_search(queries: DataFrame, vectors: DataFrame | VectorIndex | None = None, index: dict[str, DataFrame] | None = None, mode: str = "hybrid", limit: int = 10, threshold: float = THRESHOLD, path: str | None = None, sections: DataFrame | None = None, quality: str = "balanced") -> DataFrame:
    """(query_id, section_id, score, rank, sources). A side that is missing is left out of mode hybrid. Each side fetches
    twice the limit; a path glob drops results but keeps their ranks in the lists."""
    if mode == "hybrid" and (vectors is None or index is None):
        mode = "semantic" if vectors is not None else "keyword"
    fits = (lambda df: df) if path is None else (lambda df: df.join(sections.filter(path_matches(F.col("path"), path)).select("section_id"), "section_id", "left_semi"))
    near = fits(semantic_search(vectors, queries, limit * OVERFETCH, threshold, quality=quality)) if mode != "keyword" else None
    told = fits(bm25_search(index, queries, limit * OVERFETCH)) if mode != "semantic" else None
    if mode == "hybrid":
        return rrf(near, told, limit=limit)
    one, score = (near, "boosted") if mode == "semantic" else (told, "score")
    return top(one.drop("rank").withColumn("score", F.col(score)), limit).select("query_id", "section_id", "score", "rank", F.array(F.lit(mode)).alias("sources"))


def rerank(results: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], query: str = "query", text: str = "text", top_k: int = 20, n: int = 10) -> DataFrame:
    """The first ``top_k`` of each query scored anew by ``scorer(queries, texts)``: the best n with original_rank."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()), dtype="float64")

    out = results.filter(F.col("rank") <= top_k).withColumnRenamed("rank", "original_rank").withColumn("rerank_score", scored(F.col(query), F.col(text)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "original_rank")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
