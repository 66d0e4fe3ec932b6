"""The inverted-file index: recall and cells read by mode, odd vectors, hot cells; and the best rows kept in arrays."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import embedding, incremental, vector_index, vectors
from tessera.sources import corpus

SCHEMA = "section_id long, embedding array<float>"


def clustered(n: int, centers: int = 40, dims: int = 24, seed: int = 2) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dims))
    return [(i, (middle[i % centers] + 0.35 * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(3000) + [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0, 2.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path_factory.mktemp("ivf") / "index")
    vector_index.build(table, folder, neighbours=10)
    return table, vector_index.load(spark, folder)


def asked(table):
    return table.filter("section_id % 60 = 7 OR section_id >= 5000").select(F.col("section_id").alias("query_id"), "embedding")


def test_modes_trade_cells_for_recall(spark, built):
    table, index = built
    queries = asked(table)
    exact = {(r.query_id, r.section_id) for r in vectors.nearest(table, queries, 11).collect() if r.query_id != r.section_id}
    shares, files = [], []
    for mode, promised in vector_index.RECALL.items():
        found = index.nearest(queries, 11, mode).collect()
        assert len(exact & {(r.query_id, r.section_id) for r in found}) >= (promised - 0.05) * len(exact)
        shares.append(vector_index.compared_share(index, queries, mode).agg(F.avg("share")).first()[0])
        one = queries.orderBy("query_id").limit(1).toPandas()
        (_, unit), = vectors.unit_rows(one["embedding"], 24)
        cells = index.cells(unit, mode)[0].tolist()
        read = index.vectors.filter(F.col("cell").isin(cells))
        files.append(read.select(F.input_file_name()).distinct().count())
        assert "PartitionFilters: [" in read._jdf.queryExecution().toString() and "cell" in read._jdf.queryExecution().executedPlan().toString()
    assert shares[0] <= shares[1] <= 0.2 and shares[1] < shares[2] < 1 and files[0] < files[2]
    rows = lambda df: sorted((r.query_id, r.section_id, r["rank"], round(r.similarity, 9)) for r in df.collect())
    assert rows(index.nearest(queries, 11, "exact")) == rows(vectors.nearest(table, queries.filter("query_id <> 5003"), 11))
    with pytest.raises(ValueError):
        index.nearest(queries, 11, "best")


def test_odd_vectors_are_kept_and_never_found(spark, built):
    table, index = built
    assert index.vectors.count() == table.count() and index.vectors.filter("cell = -1").count() == 4
    assert {r.section_id for r in index.nearest(asked(table), 3000, "exact").collect()} == set(range(3000))
    assert index.nearest(table.limit(0).withColumnRenamed("section_id", "query_id"), 5).count() == 0


def test_empty_hot_and_equal_vectors(spark, tmp_path, monkeypatch):
    empty = vector_index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert empty.nearest(q, 5).count() == 0 and vector_index.load(spark, str(tmp_path / "none")).nearest(q, 5, "exact").count() == 0
    monkeypatch.setattr(vector_index, "CELL_ROWS", 50)
    rows = [(i, [1.0, 0.5]) for i in range(400)] + [(400 + i, [float(np.cos(i)), float(np.sin(i))]) for i in range(200)]
    index = vector_index.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "hot"), neighbours=5)
    hot = index.vectors.select("cell", F.input_file_name().alias("file")).groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).orderBy(F.desc("n")).first()
    assert hot["n"] >= 400 and hot["files"] > 1  # the hot cell was written by several tasks
    found = index.nearest(spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, embedding array<float>"), 7, "fast").orderBy("rank").collect()
    assert [r.section_id for r in found] == list(range(7))  # of equal vectors the smallest ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(1, 6), st.integers(1, 7))
def test_best_rows_match_sorting(scores, limit, step):
    """Rows come in batches; ties go to the smaller id."""
    best, seen = vectors.Best(4, limit), []
    ids = np.random.default_rng(len(scores)).permutation(len(scores))
    for a in range(0, len(scores), step):
        part = np.array(scores[a : a + step], float) / 4
        best.add(np.array([0, 1, 3]), ids[a : a + step], part)
        seen += [(i, *row) for i, row in zip(ids[a : a + step].tolist(), part.tolist())]
    have = {int(f["query_id"].iloc[0]): list(zip(f["section_id"], f["similarity"])) for f in best.rows([0, 1, 2, 3])}
    assert 2 not in have
    for place, q in ((1, 0), (2, 1), (3, 3)):
        assert have[q] == [(r[0], r[place]) for r in sorted(seen, key=lambda r: (-r[place], r[0]))[:limit]]


def test_hybrid_search_on_a_saved_index(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rng = np.random.default_rng(1)
    text = lambda k: f"# Title {k}\n\n" + " ".join(rng.choice(words, 30)) + "\n\n## Part\n\n" + " ".join(rng.choice(words, 20))
    docs = spark.createDataFrame([(f"d/{k}.md", text(k)) for k in range(60)], "path string, text string").withColumn("mtime", F.lit(None).cast("timestamp"))
    folder = str(tmp_path / "index")
    assert corpus.detect_modes(spark, folder)["recommended"] == "keyword"
    index = incremental.index_corpus(docs, folder)
    found = incremental.index_vectors(index, embedding.HashingProvider, f"{folder}/{corpus.VECTOR_INDEX}", exclude=["d/9.md"])
    assert corpus.detect_modes(spark, folder) == {"bm25": True, "vectors": True, "recommended": "hybrid"}
    assert found.vectors.filter("path = 'd/9.md'").count() == 0 and found.vectors.count() == index["sections"].filter("token_count >= 10 AND path <> 'd/9.md'").count()
    asks = spark.createDataFrame([(1, "alpha gamma"), (2, "kappa mu iota")], "query_id long, query string")
    made = embedding.embed(asks.select(F.col("query_id").alias("section_id"), F.col("query").alias("text")), embedding.HashingProvider)
    queries = made.withColumnRenamed("section_id", "query_id").join(asks, "query_id")
    rows = lambda df: sorted((r.query_id, r.section_id, round(r.score, 9), r["rank"], tuple(r.sources)) for r in df.collect())
    loaded = vector_index.load(spark, f"{folder}/{corpus.VECTOR_INDEX}")
    table = found.vectors.drop("cell")
    for path in (None, "d/1*"):
        options = dict(limit=6, threshold=0.1, path=path, sections=index["sections"])
        assert rows(vectors.hybrid_search(queries, loaded, index, quality="exact", **options)) == rows(vectors.hybrid_search(queries, table, index, **options))
    assert rows(vectors.hybrid_search(queries, loaded, index, limit=6, threshold=0.1))


def test_fitting_sends_the_driver_a_row_a_cell(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    def never(*args):
        raise AssertionError("KMeans of Spark ML sends the driver a row for each two centroids")

    monkeypatch.setattr(KMeans, "fit", never)
    table = spark.createDataFrame(clustered(900, centers=6), SCHEMA)
    found = vector_index._fitted(table, 24, 600, 12)
    assert found.shape == (12, 24) and np.allclose(np.linalg.norm(found, axis=1), 1)
    sums = vector_index._sums(table.repartition(3), found).collect()
    unit = np.array([v for _, v in clustered(900, centers=6)])
    unit = unit.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    cell = (unit @ found.T).argmax(axis=1)
    assert sorted(r.cell for r in sums) == sorted(set(cell.tolist()))
    assert all(np.allclose(np.frombuffer(r.total), unit[cell == r.cell].sum(axis=0)) for r in sums)
    assert (unit * found[cell]).sum(axis=1).mean() > 0.9  # the clusters were found


def test_best_rows_hold_a_tile_of_products(monkeypatch):
    """However many queries and rows there are, and in whatever order they come."""
    monkeypatch.setattr(vectors, "TILE", 600)
    monkeypatch.setattr(vectors, "HELD", 500)
    rng = np.random.default_rng(4)
    rows, queries = rng.integers(-1, 2, size=(700, 6)).astype(float), rng.integers(-1, 2, size=(90, 6)).astype(float)
    ids, seen = np.array([f"s{i:03d}" for i in rng.permutation(700)], object), []
    best = vectors.Best(90, 8)
    add = best.add
    monkeypatch.setattr(best, "add", lambda asks, own, similarity: (seen.append(similarity.size), add(asks, own, similarity)))
    for k in range(0, 700, 350):
        best.compare(np.arange(90), ids[k : k + 350], rows[k : k + 350], queries)
    assert max(seen) <= 600
    found = best.frame(list(range(100, 190)))
    assert len(found) == 90 * 8
    for q, own in found.groupby("query_id"):
        want = sorted(zip(-(rows @ queries[q - 100]), ids))[:8]
        assert list(zip(-own["similarity"], own["section_id"])) == want


def test_a_search_keeps_rows_for_each_core_however_many_files_it_reads(spark, built, monkeypatch):
    table, index = built
    monkeypatch.setattr(vector_index, "top", lambda scores, *_: scores)
    for c in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{c}", "4k")
    try:
        cores, queries = spark.sparkContext.defaultParallelism, asked(table)
        assert index.vectors.rdd.getNumPartitions() > 4 * cores
        scores = index.nearest(queries, 5, "thorough")
        assert scores.rdd.getNumPartitions() <= cores and scores.count() <= cores * 5 * queries.count()
    finally:
        for c in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{c}")


def test_building_works_vectors_out_twice(spark, tmp_path):
    told = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def seen(c):
        told.add(len(c))
        return c

    table = spark.createDataFrame(clustered(600), SCHEMA).withColumn("embedding", seen("embedding"))
    index = vector_index.build(table, str(tmp_path / "index"), neighbours=10)
    assert told.value <= 2 * 600 and index.vectors.count() == 600
