"""Files, index tables, incremental and continuous maintenance."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries, schemas
from tessera.operators import context, incremental, vectors
from tessera.operators.embedding import HashingProvider, embed
from tessera.sources import corpus
from tessera.streaming import reindex
from tests.compare import same

T0 = dt.datetime(2026, 1, 1)


def tables_of(tables, name="sections"):
    return sorted(map(tuple, tables[name].select("path", "heading", "start_line", "content").collect()))


def test_read_corpus(spark, tmp_path):
    for name, text in {"a.md": "# A", "sub dir/b.mdx": "# B", ".hidden/c.md": "x", "node_modules/d.md": "x", "drafts/e.md": "x", "drafts/keep.md": "# K", "f.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = corpus.read_corpus(spark, str(tmp_path), ["drafts/*", "!drafts/keep.md"])
    assert sorted((r.path, r.text) for r in found.collect()) == [("a.md", "# A"), ("drafts/keep.md", "# K"), ("sub dir/b.mdx", "# B")]


def test_ignore_files(spark, tmp_path):
    for name, text in {".gitignore": "*.md\n!important.md\n# none\n", ".mdmignore": "!a.md\ndrafts/\n", "a.md": "# A", "b.md": "x", "important.md": "# I", "drafts/important.md": "x", "more/important.md": "# M"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda **more: sorted(r.path for r in corpus.read_corpus(spark, str(tmp_path), **more).collect())
    assert names() == ["a.md", "important.md", "more/important.md"]
    assert names(exclude=["more"]) == ["a.md", "important.md"]
    assert names(ignore_files=(".mdmignore",)) == ["a.md", "b.md", "important.md", "more/important.md"]
    assert len(names(ignore_files=())) == 5


def test_index_round_trip(spark, tmp_path):
    tables = incremental.build_tables(spark.createDataFrame([("a.md", "# A\n\n[b](b.md)\n\n```\nx\n```", T0)], "path string, text string, mtime timestamp"))
    corpus.save_index(tables, str(tmp_path / "index"))
    loaded = corpus.load_index(spark, str(tmp_path / "index"))
    assert {k: sorted(map(str, t.collect())) for k, t in loaded.items()} == {k: sorted(map(str, t.collect())) for k, t in tables.items()}
    loaded["links"].drop("href").write.parquet(str(tmp_path / "bad" / "links.parquet"))
    with pytest.raises(ValueError, match="href"):
        corpus.load_index(spark, str(tmp_path / "bad"), ("links",))


def test_vector_store(spark, tmp_path):
    v = spark.createDataFrame([("s", "p", "h", [1.0, 2.0], "n2"), ("t", "p", "h", [1.0], "n1")], "section_id string, path string, heading string, embedding array<float>, namespace string")
    corpus.save_vectors(v, str(tmp_path))
    assert corpus.load_vectors(spark, str(tmp_path), "n2", 2).count() == 1
    with pytest.raises(ValueError, match="1 dimensions"):
        corpus.load_vectors(spark, str(tmp_path), "n1", 2)
    assert corpus.detect_modes(spark, str(tmp_path)) == {"bm25": False, "vectors": True, "recommended": "semantic"}


def versions(spark):
    schema = "path string, text string, mtime timestamp"
    later = T0 + dt.timedelta(minutes=1)
    old = spark.createDataFrame([("a.md", "# A\none", T0), ("b.md", "# B", T0), ("c.md", "# C", T0)], schema)
    new = spark.createDataFrame([("a.md", "# A\ntwo", later), ("c.md", "# C", T0), ("d.md", "# D", later)], schema)
    return old, new


def test_increment_equals_rebuild(spark):
    old, new = versions(spark)
    tables = incremental.build_tables(old)
    changes = incremental.diff_corpus(tables["documents"], incremental.fingerprints(new))
    assert {r.path: r.change for r in changes.collect()} == {"a.md": "changed", "b.md": "deleted", "c.md": "unchanged", "d.md": "new"}
    assert tables_of(incremental.apply_changes(tables, changes, new)) == tables_of(incremental.build_tables(new))
    assert tuple(incremental.index_report(changes).first()) == (2, 1, 1, 3)


def test_stream_equals_batch(spark, tmp_path):
    old, new = versions(spark)
    feed = tmp_path / "feed"
    schema = "path string, text string, mtime timestamp, op string"
    first = old.withColumn("op", F.lit("add"))
    late = T0 + dt.timedelta(minutes=2)
    second = new.filter("path <> 'c.md'").withColumn("op", F.lit("change")).unionByName(spark.createDataFrame([("b.md", None, late, "delete"), ("d.md", "# old", T0, "add")], schema))
    seen = []
    for rows in (first, second):
        rows.coalesce(1).write.mode("append").parquet(str(feed))
        source = spark.readStream.schema(schema).parquet(str(feed))
        reindex.stream_index(source, str(tmp_path / "index"), str(tmp_path / "checkpoint"), {"availableNow": True}, on_index=seen.append).awaitTermination()
    version, tables = reindex.current(spark, str(tmp_path / "index"))
    assert (version, seen) == (1, [0, 1])
    assert tables_of({k: tables[k] for k in schemas.TABLES}) == tables_of(incremental.build_tables(new))
    again = reindex.apply_burst(second, 1, str(tmp_path / "index")).first()  # the same burst once more changes nothing
    assert (again["batch"], again["indexed"], again["deleted"]) == (1, 2, 1)


def test_packing_stays_in_budget_and_grows_with_it(spark):
    items = spark.createDataFrame([("q", i, t, t // 3) for i, t in enumerate((60, 70, 40, 5, 90, 30))], "query_id string, place int, tokens int, brief_tokens int")
    last = -1
    for budget in (0, 10, 50, 100, 150, 400):
        rows = context.assemble_context(items, budget).orderBy("place").collect()
        assert max(r.used for r in rows) <= budget
        assert (taken := sum(r.included != "overflow" for r in rows)) >= last
        last = taken
    assert [r.included for r in rows] == ["full"] * 6


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, section_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, section_id string, rank int")
    scores = lambda r: {x.section_id: round(x.score, 12) for x in r.collect()}
    assert scores(vectors.rrf(a, b)) == scores(vectors.rrf(b, a))
    assert vectors.rrf(a, b).orderBy("rank").first().section_id == "y"


def test_embedding_is_deterministic_and_tried_again(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "section_id int, text string")

    class Flaky(HashingProvider):
        failed = False

        def embed(self, batch):
            if not self.failed:
                self.failed = True
                raise ConnectionError
            return super().embed(batch)

    one = embed(texts, HashingProvider).orderBy("section_id").collect()
    assert one == embed(texts, Flaky, wait=0.0).orderBy("section_id").collect()


def test_many_files_are_read_in_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i % 3}" / "in ner").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 3}" / "in ner" / f"n+{i}%.md").write_bytes(b"\xff text %d" % i)
    (tmp_path / ".hidden").mkdir()
    for name in (".hidden/x.md", "_x.md", "empty.md", "x.txt"):
        (tmp_path / name).write_text("" if name == "empty.md" else "x")
    found = corpus.read_corpus(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = {r.path: bytes(r.raw) for r in found.selectExpr("path", "cast(text AS binary) AS raw").collect()}
    assert rows == {f"d{i % 3}/in ner/n+{i}%.md": b"\xff text %d" % i for i in range(300)}


def test_files_without_a_byte_are_read_if_asked_for(spark, tmp_path):
    for name, text in {"a.md": "# A", "b c/empty.mdx": "", "empty.txt": "", ".hidden/e.md": "", "_e.md": "", "drafts/e.md": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    told = lambda df: sorted((r.path, r.text, r.mtime is None) for r in df.collect())
    want = [("a.md", "# A", False), ("b c/empty.mdx", "", False)]
    assert told(corpus.read_corpus(spark, str(tmp_path), ["drafts/"], empty=True)) == want
    assert told(corpus.read_corpus(spark, str(tmp_path), ["drafts/"])) == want[:1]
    by_spark = corpus._read_by_spark(spark, f"file://{tmp_path}", empty=True)  # of a store that Arrow doesn't know
    assert told(corpus.filter_ignored(by_spark, ["drafts/"])) == want


def test_an_empty_document_is_scanned(spark, data, tmp_path):
    own = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 20")
    own.selectExpr("doc_id", "CASE doc_id WHEN 10 THEN '' WHEN 11 THEN NULL ELSE text END AS text", "CASE doc_id WHEN 10 THEN 'en' ELSE lang END AS lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.directory_scan(spark, str(tmp_path)), queries.SQL["directory_scan"], con)
