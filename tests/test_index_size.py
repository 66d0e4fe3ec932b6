"""What an index weighs: ids are short whatever a heading is, postings aren't shuffled, and parts are written when asked for."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import bm25, extract, incremental
from tests.compare import plain

LONG = "word after another " * 400


def rows(df):
    return sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())


def corpus(spark):
    texts = [(f"d/{i}.md", f"{LONG}{i}\nthe rest of it {'common ' * i}") for i in range(8)] + [("a.md", "# Short head\n\none two two three three three words here"), ("n.md", None)]
    return spark.createDataFrame([(p, t, None) for p, t in texts], "path string, text string, mtime timestamp")


def test_ids_are_short_and_differ(spark):
    made = extract.extract_sections(corpus(spark).select("path", "text"), preamble=True).select("section_id", "path", "heading").collect()
    ids = [r.section_id for r in made]
    assert max(map(len, ids)) < 100 and len(set(ids)) == len(ids)
    assert max(len(r.heading) for r in made) > 7000  # the heading itself stays whole
    assert next(r.section_id for r in made if r.path == "a.md").endswith("-short-head-L1")


def test_postings_are_counted_in_the_row(spark):
    own = spark.createDataFrame([("s1", "Two heads", "two one one one heads", 20), ("s2", "", "", 20), ("s3", None, None, 20), ("s4", "a b", "c d", 20), ("s5", "x", "few words here", 3), ("s6", "Éa été", "ÉTÉ été zzz zzz", 20)], "section_id string, heading string, content string, token_count int")
    some = bm25.section_lengths(own)
    weighted = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    want = some.select("section_id", "dl", F.explode(F.concat(weighted("h", bm25.HEADING_WEIGHT), weighted("c", bm25.CONTENT_WEIGHT))).alias("x")).groupBy(F.col("x.term").alias("term"), "section_id", "dl").agg(F.sum("x.w").alias("tf"))
    have = bm25.build_postings(own)["postings"]
    assert rows(have) == rows(want) and have.count() == 4
    assert "Exchange" not in have._jdf.queryExecution().toString()


def test_parts_equal_a_whole_index_and_come_when_asked_for(spark, tmp_path):
    whole = incremental.index_corpus(corpus(spark), str(tmp_path / "whole"), preamble=True)
    folder = tmp_path / "parts"
    part = incremental.index_sections(corpus(spark), str(folder), preamble=True)
    assert [p.name for p in folder.iterdir()] == ["sections.parquet"]
    for name in incremental.PARTS:
        part |= incremental.index_parts(corpus(spark), part["sections"], str(folder), name)
    assert set(part) == set(schemas.TABLES | schemas.SEARCH_TABLES)
    for name, df in whole.items():
        assert rows(part[name].select(*df.columns)) == rows(df), name


def test_files_are_in_order_of_the_term(spark, tmp_path):
    incremental.index_corpus(corpus(spark).repartition(3), str(tmp_path), preamble=True)
    for table, by in {"postings": ["term", "level", "section_id"], "words": ["word", "section_id"], "lookups": ["key", "word"]}.items():
        for file in Path(tmp_path / f"{table}.parquet").glob("*.parquet"):
            held = [tuple(r[c] for c in by) for r in pq.read_table(file).to_pylist()]
            assert held == sorted(held), table
