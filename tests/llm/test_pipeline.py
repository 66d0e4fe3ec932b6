from __future__ import annotations

import corpus_pipeline
from tests.llm import brute


def test_stages_match_brute_force(spark, messy, messy_df, data):
    """Each stage on what its predecessor kept."""
    docs = messy_df.select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    steps = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = steps[name](spark, df, data)
        assert out.columns == df.columns
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        return spark.createDataFrame([tuple(r) for r in out.collect()], df.schema), rows

    good, rows = step("quality_rules", docs)
    assert all(not brute.quality(t)[5] for t in rows.values())
    unique, one = step("ngram_jaccard_join", good)
    assert set(one) == set(brute.components(list(rows.items())).values())
    lean, kept = step("suffix_array_dedup", unique)
    want = brute.dedup(sorted(one.items()))
    assert {i: len(t.encode()) for i, t in kept.items()} == {i: w[0] - w[1] for i, w in want.items() if w[0] > w[1]}
    clean, left = step("benchmark_decontamination", lean)
    assert set(left) <= set(kept)
    packed = steps["packing"](spark, clean, data).collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(r["length"] > 0 for r in rows)
