"""An inverted-file index of vectors: cells around centroids, and searches that read the cells nearest to a query alone.

Centroids come from spherical k-means over a bounded sample; every vector is then assigned to its nearest centroid and
written below a folder for each cell, so that a search prunes whole files. How many cells a mode looks at isn't fixed: for
a sample of queries the exact neighbours are found once, by one pass over all vectors, and the cells are counted that hold
the share of them which the mode promises. Vectors in clusters need few cells; vectors without any structure need many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.bm25 import top
from tessera.operators.vectors import MOST_QUERIES, TILE, Best, nearest, unit_rows
from tessera.sources.scratch import passing

#: Share of the exact neighbours that each mode finds on average, and the neighbours that it is counted for.
RECALL = {"fast": 0.8, "balanced": 0.9, "thorough": 0.97}
NEIGHBOURS = 20
#: Vectors that centroids are fitted on, queries that modes are measured with, and cells, at most.
SAMPLE_ROWS, CALIBRATION_ROWS, MOST_CELLS = 65_536, 200, 4_096
#: Rounds of k-means at most, and rows of the sample that a task has at least.
ROUNDS, FIT_ROWS = 12, 4_096
#: Rows for each cell that the first centroids are drawn from.
SEEDS = 4
#: Vectors of a cell that go to one task when the index is written, so that a hot cell is dealt over many.
CELL_ROWS = 100_000
#: A vector without a direction, or of other dimensions, is in this cell, which no search reads.
NOWHERE = -1


@dataclass
class VectorIndex:
    """What a search needs: the vectors (with their cell), the centroids, how many vectors each cell has, and how many cells
    each mode looks at; mode exact looks at all."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    probes: dict[str, int]

    def __post_init__(self):
        self.probes = {**self.probes, "exact": len(self.centroids)}

    def nearest(self, queries: DataFrame, limit: int = 10, mode: str = "balanced") -> DataFrame:
        return search(self, queries, limit, mode)

    def cells(self, queries: np.ndarray, mode: str) -> np.ndarray:
        """The cells nearest to each query (rows of length 1), the nearest first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, : self.probes[mode]]


def _nearest_cells(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each row of length 1, a tile of products at a time."""
    step = max(1, TILE // len(centroids))
    return np.concatenate([(unit[k : k + step] @ centroids.T).argmax(axis=1) for k in range(0, len(unit), step)])


def _cell_of(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors with their cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = shared.value
        for series in batches:
            out = np.full(len(series), NOWHERE, np.int32)
            for at, unit in unit_rows(series, c.shape[1]):
                out[at] = _nearest_cells(unit, c)
            yield pd.Series(out)

    return vectors.withColumn("cell", cell("embedding"))


def _fitted(vectors: DataFrame, dims: int, rows: int, most_cells: int) -> np.ndarray:
    """The centroids of at most ``rows`` vectors, those whose ids have the smallest hashes: spherical k-means.

    Tasks add up the vectors of each cell, and the sums of a cell meet in one task; in each round the driver gets a row a
    cell. (The KMeans of Spark ML sends it a row for each two centroids.)
    """
    own = vectors.filter((F.size("embedding") == dims) & F.exists("embedding", lambda x: x != 0)).select("section_id", "embedding")
    n = own.count()
    cells = max(1, min(most_cells, int(2 * n**0.5), n))
    if not n:
        return np.zeros((1, dims))
    order = F.xxhash64(F.col("section_id").cast("string"))
    least = -(2**63) + int(min(1.0, 1.1 * rows / n) * (2**64 - 1))  # hashes up to here have the sample and some more
    with passing() as keep:
        tasks = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-min(n, rows) // FIT_ROWS))
        some = own.filter(order <= F.lit(min(least, 2**63 - 1))).orderBy(order, "section_id").limit(rows)
        sample = keep(some.repartition(tasks, "section_id"))
        seeds = sample.groupBy("embedding").agg(F.min("section_id").alias("section_id")).orderBy(order, "section_id").limit(SEEDS * cells).collect()
        _, seeds = next(unit_rows(pd.Series([r["embedding"] for r in seeds]), dims))
        found = _apart(seeds, cells)
        for _ in range(ROUNDS):
            sums = np.zeros_like(found)
            for r in _sums(sample, found).collect():
                sums[r["cell"]] = np.frombuffer(r["total"])
            length = np.linalg.norm(sums, axis=1)
            moved = np.where(length[:, None] > 1e-12, sums / np.maximum(1e-12, length)[:, None], found)  # an empty cell stays
            still, found = np.abs(moved - found).max() < 1e-6, moved
            if still:
                break
    return found


def _apart(rows: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of some rows, by greedy k-means++: of a few drawn by their squared distance to those before, the one
    that brings the others nearest."""
    draw, taken, tries = np.random.default_rng(1), [0], 2 + int(np.log(most))
    far = np.maximum(0.0, 1 - rows @ rows[0])
    while len(taken) < most and far.sum() > 1e-9:
        drawn = draw.choice(len(rows), size=tries, p=far / far.sum())
        left = np.minimum(far[:, None], np.maximum(0.0, 1 - rows @ rows[drawn].T))
        best = left.sum(axis=0).argmin()
        taken.append(int(drawn[best]))
        far = left[:, best]
    return rows[taken]


def _sums(sample: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cell, total): the sum of the vectors of length 1 that are nearest to each centroid, as bytes of doubles."""
    shared = sample.sparkSession.sparkContext.broadcast(centroids)

    def added(cells: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
        order = np.argsort(cells, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(cells[order]) > 0])
        return pd.DataFrame({"cell": cells[order][first], "total": [t.tobytes() for t in np.add.reduceat(totals[order], first)]})

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, unit in unit_rows(batch["embedding"], shared.value.shape[1]):
                yield added(_nearest_cells(unit, shared.value), unit)

    def of_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, total in zip(batch["cell"], batch["total"]):
                sums[cell] = sums.get(cell, 0.0) + np.frombuffer(total)
        yield pd.DataFrame({"cell": list(sums), "total": [t.tobytes() for t in sums.values()]}, columns=["cell", "total"])

    parts = sample.mapInPandas(of_rows, "cell int, total binary")
    return parts.repartition(parts.sparkSession.sparkContext.defaultParallelism, "cell").mapInPandas(of_cells, "cell int, total binary")


def build(vectors: DataFrame, folder: str, neighbours: int = NEIGHBOURS, sample_rows: int = SAMPLE_ROWS, calibration_rows: int = CALIBRATION_ROWS, most_cells: int = MOST_CELLS) -> VectorIndex:
    """Write an index of (section_id, embedding, ...) below the folder and return it as it is read back.

    Other columns are kept. Null, empty and zero vectors, and those whose dimension isn't the most frequent one, are kept
    beside the cells and found by no search. An empty table gives an index that finds nothing.
    """
    spark = vectors.sparkSession
    with passing() as keep:  # ids and vectors are read often, what they come from twice
        own = keep(vectors.select("section_id", "embedding"))
        sizes = own.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = sizes["d"] if sizes else 1
        centroids = _fitted(own, dims, sample_rows, most_cells)
        # a cell goes to as many tasks as its rows need; which cells are hot is known from the number of rows of each
        counts = {r["cell"]: r["count"] for r in _cell_of(own, centroids).groupBy("cell").count().collect()}
    assigned = _cell_of(vectors, centroids)
    hot = {c: n // CELL_ROWS + 1 for c, n in counts.items() if n > CELL_ROWS}
    parts = F.lit(1)
    for c, n in hot.items():
        parts = F.when(F.col("cell") == c, n).otherwise(parts)
    share = F.pmod(F.xxhash64(F.col("section_id").cast("string")), parts)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(hot.values()))
    assigned.repartition(tasks, "cell", share).write.partitionBy("cell").parquet(f"{folder}/cells")
    stored = spark.read.schema(assigned.schema).parquet(f"{folder}/cells")
    index = VectorIndex(stored, centroids, np.array([counts.get(k, 0) for k in range(len(centroids))]), {})
    index.probes |= _calibrated(index, neighbours, calibration_rows)
    rows = [(k, c.tolist(), int(n)) for k, (c, n) in enumerate(zip(centroids, index.sizes))]
    spark.createDataFrame(rows, "cell int, centroid array<double>, vectors long").coalesce(1).write.parquet(f"{folder}/centroids")
    modes = [(mode, n, assigned.schema.json()) for mode, n in index.probes.items()]  # without vectors no file tells the columns
    spark.createDataFrame(modes, "mode string, probes int, columns string").coalesce(1).write.parquet(f"{folder}/modes")
    return index


def _calibrated(index: VectorIndex, neighbours: int, rows: int) -> dict[str, int]:
    """How many cells hold, on average, the share of a query's exact neighbours that each mode promises."""
    known = index.vectors.filter(F.col("cell") != NOWHERE)
    order = F.xxhash64(F.col("section_id").cast("string"), F.lit(7))
    some = known.orderBy(order, "section_id").limit(rows).select(F.col("section_id").alias("query_id"), "embedding")
    near = nearest(known, some, neighbours + 1).filter("section_id <> query_id").join(known.select("section_id", "cell"), "section_id").select("query_id", "cell")
    found = near.groupBy("query_id").agg(F.collect_list("cell").alias("cells")).join(some, "query_id").collect()  # rows * neighbours cells at most
    places = [np.zeros(0, np.int64)]
    for r in found:
        q = np.asarray(r["embedding"], np.float64)
        rank = np.argsort(np.argsort(-(index.centroids @ (q / np.linalg.norm(q))), kind="stable"), kind="stable")
        places.append(rank[r["cells"]])
    place = np.sort(np.concatenate(places)) + 1
    return {mode: int(place[max(0, int(np.ceil(share * len(place))) - 1)]) if len(place) else 1 for mode, share in RECALL.items()}


def load(spark: SparkSession, folder: str) -> VectorIndex:
    """An index as ``build`` wrote it."""
    cells = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
    modes = spark.read.parquet(f"{folder}/modes").collect()
    vectors = spark.read.schema(StructType.fromJson(json.loads(modes[0]["columns"]))).parquet(f"{folder}/cells")
    return VectorIndex(vectors, np.array([r["centroid"] for r in cells]), np.array([r["vectors"] for r in cells]), {r["mode"]: r["probes"] for r in modes})


def _blocks(queries: DataFrame, dims: int) -> Iterator[tuple[list, np.ndarray]]:
    """Queries that have a direction, in blocks of about MOST_QUERIES: their ids and their vectors of length 1."""
    asked = queries.select("query_id", "embedding")
    blocks = -(-asked.count() // MOST_QUERIES)
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).orderBy("query_id").toPandas()
        for at, unit in unit_rows(block["embedding"], dims):
            yield block["query_id"].iloc[at].tolist(), unit


def search(index: VectorIndex, queries: DataFrame, limit: int = 10, mode: str = "balanced") -> DataFrame:
    """(query_id, section_id, similarity, rank): the best of the cells that ``mode`` looks at for each query.

    Files of other cells aren't read. A task takes many files, compares each cell's vectors with the queries that look at it,
    and keeps ``limit`` of each query; there are as many tasks as cores, so what is shuffled is cores x queries x limit rows.
    """
    if mode not in index.probes:
        raise ValueError(f"mode is one of {', '.join(index.probes)}")
    spark, out = queries.sparkSession, []
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, section_id {index.vectors.schema['section_id'].dataType.simpleString()}, similarity double"
    for ids, unit in _blocks(queries, index.centroids.shape[1]):
        wanted = np.zeros((len(index.centroids), len(ids)), bool)
        np.put_along_axis(wanted.T, index.cells(unit, mode), True, axis=1)
        read = [int(k) for k in np.flatnonzero(wanted.any(axis=1))]
        shared = spark.sparkContext.broadcast((ids, unit, np.packbits(wanted, axis=1)))  # a bit for each cell and query
        read = index.vectors.filter(F.col("cell").isin(read)).select("section_id", "embedding", "cell").coalesce(spark.sparkContext.defaultParallelism)
        out.append(read.mapInPandas(_compared(shared, limit), kinds))
    if not out:
        return spark.createDataFrame([], kinds + ", rank int")
    return top(reduce(DataFrame.unionByName, out), limit, "similarity")


def _compared(shared, limit: int):
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit, wanted = shared.value
        best = Best(len(ids), limit)
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                asks = np.flatnonzero(np.unpackbits(wanted[int(cell)], count=len(ids)))
                for at, rows in unit_rows(part["embedding"], unit.shape[1]):
                    best.compare(asks, part["section_id"].to_numpy()[at], rows, unit[asks])
        yield best.frame(ids)

    return compared


def compared_share(index: VectorIndex, queries: DataFrame, mode: str = "balanced") -> DataFrame:
    """(query_id, cells, compared, share): the cells that a mode looks at, and the vectors in them, of all."""
    total = max(1, int(index.sizes.sum()))
    kind = queries.schema["query_id"].dataType.simpleString()
    parts = []
    for ids, unit in _blocks(queries, index.centroids.shape[1]):
        cells = index.cells(unit, mode)
        held = index.sizes[cells].sum(axis=1)
        rows = [(i, cells.shape[1], int(n), float(n / total)) for i, n in zip(ids, held)]
        parts.append(queries.sparkSession.createDataFrame(rows, f"query_id {kind}, cells int, compared long, share double"))
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], f"query_id {kind}, cells int, compared long, share double")
