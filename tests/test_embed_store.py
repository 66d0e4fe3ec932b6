"""Embeddings that are asked for once, whatever fails; folders and patterns as tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators.embed_store import embed_once, fill, known
from tessera.operators.embedding import HashingProvider, embed
from tessera.plans.patterns import judged_patterns
from tessera.sources import corpus

SCHEMA = "section_id long, text string"


class Counting(HashingProvider):
    """Notes each text that it is asked for in a file of its own, and fails at a marked text while a file says so."""

    def __init__(self, folder: str):
        super().__init__()
        self.folder = folder

    def embed(self, texts):
        if os.path.exists(f"{self.folder}/fails") and any("bad" in t for t in texts):
            raise RuntimeError("the provider is down")
        for t in texts:
            with open(f"{self.folder}/asked-{abs(hash(t))}-{os.urandom(6).hex()}", "w") as out:
                out.write(t)
        return super().embed(texts)


def asked(folder: Path) -> list[str]:
    return sorted(p.read_text() for p in folder.glob("asked-*"))


def test_a_provider_that_fails_midway_is_asked_for_no_text_twice(spark, tmp_path):
    (notes := tmp_path / "notes").mkdir()
    (notes / "fails").touch()
    rows = [(i, f"text {i % 90}" + (" bad" if i == 41 else "")) for i in range(120)] + [(500, None), (501, "")]
    table, store, folder = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "store"), str(notes)
    provider = lambda: Counting(folder)
    with pytest.raises(Exception, match="the provider is down"):
        fill(table, provider, store, "n", batch_size=4)
    done = asked(notes)
    assert 0 < len(done) < 92 and len(set(done)) == len(done) == known(spark, store, "n").count()
    (notes / "fails").unlink()
    told = fill(table, provider, store, "n", batch_size=7)  # batches of another size
    everything = asked(notes)
    assert len(everything) == len(set(everything)) == len({t or "" for _, t in rows}) == len(done) + told["asked"]
    assert fill(table, provider, store, "n")["asked"] == 0 and asked(notes) == everything
    have = {r.section_id: list(r.embedding) for r in embed_once(table, provider, store, "n").collect()}
    want = {r.section_id: list(r.embedding) for r in embed(table.fillna(""), HashingProvider).collect()}
    assert have == want and asked(notes) == everything
    assert known(spark, store, "n").agg(F.sum("tokens")).first()[0] == sum(len(t.split()) for t in everything)


def test_a_batch_is_committed_once(spark, tmp_path):
    from tessera.operators import embed_store

    made = []
    make = lambda: made.append(1) or __import__("pyarrow").Table.from_pydict({"content_hash": ["a"], "embedding": [[1.0]], "tokens": [1]}, schema=embed_store.ROWS)
    assert embed_store._committed(str(tmp_path / "s"), "k", make) and not embed_store._committed(str(tmp_path / "s"), "k", make) and made == [1]
    with pytest.raises(ZeroDivisionError):
        embed_store._committed(str(tmp_path / "s"), "j", lambda: 1 / 0)
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["k.parquet"]
    assert known(spark, str(tmp_path), "none").count() == 0
    assert embed_once(spark.createDataFrame([], SCHEMA), HashingProvider, str(tmp_path), "none").count() == 0


def test_folders_come_back_as_they_were_written(spark, tmp_path):
    rows = [("a b/c+d.md", "# A\n\r\nñ漢"), ("a b/e.mdx", ""), ("x.md", None), ("deep/er/y.md", "y" * 10_000)]
    corpus.write_folder(spark.createDataFrame(rows, "path string, text string"), str(tmp_path / "out"))
    assert sorted((r.path, r.text) for r in corpus.read_corpus(spark, str(tmp_path / "out")).collect()) == sorted((p, t) for p, t in rows if t)


def test_patterns_of_a_table_are_judged(spark):
    given = ["abc", "(a+)+", "(", "x" * 300, None, "", r"\p{Lu}"]
    rows = judged_patterns(spark.createDataFrame(list(enumerate(given)), "id int, pattern string")).orderBy("id").collect()
    assert [r.safe for r in rows] == [True, False, False, False, False, True, False]
    assert "backtrack" in rows[1].reason and "not a pattern" in rows[2].reason and "300" in rows[3].reason and rows[0].reason is None
