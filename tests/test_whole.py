"""Operators over groups, texts and query sides larger than the test tables have."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tessera import queries
from tessera.corpora import table
from tessera.operators import duplicates, incremental, vectors


def test_exact_duplicates_of_a_large_group_are_all_told(spark):
    own = spark.range(1203).selectExpr("format_string('%05d', id) AS path", "1 AS start_line", "format_string('s%05d', id) AS section_id", "'h' AS heading", "repeat('same text ', 9) AS content")
    found = duplicates.exact_duplicates(own).selectExpr("size", "primary.path AS first", "duplicates.path AS others").first()
    assert (found.size, found.first, found.others) == (1203, "00000", [f"{i:05d}" for i in range(1, 1203)])
    assert sorted(r.place for r in duplicates.duplicate_members(own).collect()) == list(range(1, 1204))


@pytest.mark.parametrize("block", [64, 4096])
def test_near_duplicates_lose_no_pair_and_no_copy(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    some = np.concatenate([base, base[:50] + 0.25 * rng.normal(size=(50, 16)), base[:30], np.zeros((2, 16))]).astype(np.float32)
    own = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some)] + [(900, [1.0]), (901, None)], "section_id long, embedding array<float>")
    unit = some[:200].astype(float) / np.linalg.norm(some[:200].astype(float), axis=1)[:, None]
    want = {(a, b) for a, b in zip(*map(lambda x: x.tolist(), np.nonzero(unit @ unit.T >= duplicates.SIMILAR))) if a < b}
    found = [(r.a, r.b) for r in duplicates.near_duplicates(own).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 30
    classes = {r.section_id: (r.class_id, r["size"]) for r in duplicates.vector_classes(own).collect()}
    assert classes == {i: (i - 200, 2) if 200 <= i < 230 else (230, 2) if i in (230, 231) else (i, 2 if i < 30 else 1) for i in (*range(232), 900)}


def test_near_duplicates_shuffle_a_vector_once_a_block(spark, monkeypatch):
    """The blocks don't grow with the table, so what is shuffled grows no faster than it."""
    monkeypatch.setattr(duplicates, "BLOCK", 4)
    dealt = []
    for n in (100, 1000):
        own = spark.range(n).selectExpr("id AS section_id", "array(cast(sin(id) AS float), cast(cos(id) AS float)) AS embedding")
        found = duplicates.near_duplicates(own, 0.9999).collect()
        unit = np.array([r.embedding for r in own.orderBy("section_id").collect()])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        assert {(r.a, r.b) for r in found} == {(a, b) for a, b in zip(*map(lambda x: x.tolist(), np.nonzero(unit @ unit.T >= 0.9999))) if a < b}
        plan = duplicates.near_duplicates(own)._jdf.queryExecution().optimizedPlan().toString()
        dealt.append(re.sub(r"#\d+", "", plan.split("explode(")[1].split("]")[0]))
    assert dealt[0] == dealt[1]


@pytest.mark.parametrize("name", ["vector_search", "vector_search_stats", "approximate_search", "semantic_search", "rank_fusion"])
def test_every_hundredth_vector_is_searched_for(spark, data, name):
    want = {r.vec_id for r in table(spark, data, "embeddings").filter("vec_id % 100 = 0").collect()}
    known = want & {r.doc_id for r in table(spark, data, "documents").collect()}  # the others may miss the threshold
    found = {r.query_id for r in queries.QUERIES[name](spark, data).select("query_id").distinct().collect()}
    assert known <= found <= want and len(known) > 1
    if name in ("vector_search_stats", "rank_fusion"):
        assert found == want


def test_approximate_search_has_recall_at_the_limit_in_use(spark, data):
    v = table(spark, data, "embeddings").selectExpr("vec_id AS section_id", "embedding")
    q = table(spark, data, "embeddings").filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")
    others = lambda df: {(r.query_id, r.section_id) for r in df.filter("query_id <> section_id").collect()}
    exact = others(vectors.nearest(v, q, queries.NEAR + 1))
    found = others(vectors.vector_search(v, q, queries.NEAR + 1, -1.0, "thorough"))
    print("recall", len(exact & found), len(exact))
    assert len(exact) == 10 * queries.NEAR and len(exact & found) >= 0.9 * len(exact)


def test_whole_texts_are_named_and_asked(spark, tmp_path):
    word = "abcdefghi "
    rows = [(1, word * 7 + "end -- here!", "src0"), (2, "one" * 30 + " two three four five six", "src0"), (3, "x" * 70 + " y z?", "src0"), (4, "x" * 70 + " y z", "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    slugs = {r.doc_id: r.slug for r in queries.identities(spark, str(tmp_path)).collect()}
    assert slugs[1] == "abcdefghi-" * 7 + "end-here" and slugs[2].endswith("-two-three-four-five-six")
    forms = {r.doc_id: (r.query, r.expand) for r in queries.query_normal_forms(spark, str(tmp_path)).collect()}
    assert forms[1] == (word * 7 + "end here", True)
    assert [forms[i][1] for i in (2, 3, 4)] == [True, True, False]


def test_code_blocks_of_every_language_are_extracted(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb", "en", "src0"), (2, "c", "fr", "src0"), (3, "d", None, "src1")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.extract_code_blocks(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, "src0", "a\nb", 3, 6), (2, "src0", "c", 3, 5), (3, "src1", "d", 3, 5)]


def test_a_frequent_heading_is_dealt_over_tasks(spark):
    own = spark.range(20000).selectExpr("'User' AS heading", "format_string('s%05d', id) AS section_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put small partitions together
    try:
        found = incremental.heading_rows(own).rdd.glom().map(lambda rows: [tuple(r) for r in rows]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [x for part in found for x in part] == [("user", f"s{i:05d}") for i in range(20000)]
    assert max(map(len, found)) < 10000
    assert [tuple(r) for r in incremental.heading_counts(own).collect()] == [("user", 20000)]
