"""Keeping a corpus up to date."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as tx
from tessera.functions.stem import stem_vocabulary, text_words
from tessera.operators import embedding, extract, vector_index
from tessera.operators.bm25 import build_postings, impact_blocks, with_levels
from tessera.operators.embedding import EmbeddingProvider
from tessera.operators.links import resolve_links
from tessera.operators.lookups import lookup_rows
from tessera.sources.corpus import spread
from tessera.sources.scratch import passing


def fingerprints(corpus: DataFrame) -> DataFrame:
    """(path, content_hash, mtime)."""
    return corpus.select("path", tx.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), "mtime")


def diff_corpus(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged (hash and mtime both equal) or deleted."""
    a = old.select("path", F.col("content_hash").alias("h0"), F.col("mtime").alias("m0"), F.lit(True).alias("in0"))
    b = new.select("path", F.col("content_hash").alias("h1"), F.col("mtime").alias("m1"), F.lit(True).alias("in1"))
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("m0").eqNullSafe(F.col("m1"))
    change = F.when(F.col("in0").isNull(), "new").when(F.col("in1").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def build_tables(corpus: DataFrame, preamble: bool = False) -> dict[str, DataFrame]:
    """All tables of an index from (path, text, mtime)."""
    front = extract.split_frontmatter(corpus)
    body = front.select("path", F.col("body").alias("text"))
    sections = extract.extract_sections(_bodies(front), preamble=preamble)
    links = resolve_links(extract.in_sections(extract.extract_links(body).drop("k"), sections))
    code = extract.in_sections(extract.extract_code_blocks(body).withColumn("line", F.col("start_line")), sections).drop("line")
    stats = extract.document_stats(front, sections, links, code)
    documents = stats.join(front.select("path", "frontmatter", "tags", "mtime"), "path")
    return {"documents": documents, "sections": sections, "links": links, "code_blocks": code}


def _bodies(front: DataFrame) -> DataFrame:
    """(path, text) of bodies; a null text has none, unlike an empty one."""
    return front.select("path", F.when(F.col("text").isNotNull(), F.col("body")).alias("text"))


#: What an index has beside its sections, by part; each part can be written by itself. Of ranking, "postings" is what a
#: segment of a log has, which counts terms by itself.
PARTS = {"structure": ("links", "code_blocks", "documents"), "ranking": ("postings", "impacts", "term_stats", "stats"), "vocabulary": ("words", "vocabulary", "lookups")}


def index_corpus(corpus: DataFrame, folder: str, preamble: bool = False, parts: tuple[str, ...] = tuple(PARTS)) -> dict[str, DataFrame]:
    """Write all tables of an index from (path, text, mtime), search tables included, and return them as they are read back;
    of fewer ``parts``, the sections and what these hold.

    Each table is made from those written before it, so a text is parsed once. Tables that don't need each other are written
    side by side, so that the few tasks at a job's end leave no cores idle. Each file of postings and words holds those of its
    own sections in order of the term, and each of lookups its words' keys in order: none of them is shuffled, ids recur
    within a file and so are coded in few bits, and a search reads the pages of its own terms.
    """
    if "structure" not in parts:  # nothing else reads the corpus again
        out = index_sections(corpus, folder, preamble)
        return out | (index_parts(corpus, out["sections"], folder, *parts) if parts else {})
    with passing() as keep:
        front = extract.split_frontmatter(corpus)
        text = F.coalesce("text", F.lit(""))
        front = keep(front.withColumn("body", F.when(F.col("body") != text, F.col("body"))))  # most texts are all body: kept once
        front = front.withColumn("body", F.coalesce("body", text))
        out = _sections(front, folder, preamble)
        out |= _parts(front, out["sections"], folder, parts)
    return {k: out[k] for k in (*schemas.TABLES, *schemas.SEARCH_TABLES) if k in out}


def index_sections(corpus: DataFrame, folder: str, preamble: bool = False) -> dict[str, DataFrame]:
    """Write an index that has its sections alone, for searches of texts; ``index_parts`` adds what others look up."""
    return _sections(extract.split_frontmatter(corpus), folder, preamble)


def index_parts(corpus: DataFrame, sections: DataFrame, folder: str, *parts: str) -> dict[str, DataFrame]:
    """Write the tables of some PARTS of an index beside its sections; the corpus is read for structure alone."""
    return _parts(extract.split_frontmatter(corpus), sections, folder, parts)


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}.parquet")


def _sections(front: DataFrame, folder: str, preamble: bool) -> dict[str, DataFrame]:
    return {"sections": _kept(extract.extract_sections(_bodies(front), preamble=preamble), folder, "sections")}


def _parts(front: DataFrame, sections: DataFrame, folder: str, parts: tuple[str, ...]) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}

    def kept(name: str, df: DataFrame) -> DataFrame:
        return _kept(df, folder, name)

    def structure() -> None:
        body = front.select("path", F.col("body").alias("text"))
        out["links"] = kept("links", resolve_links(extract.in_sections(extract.extract_links(body).drop("k"), sections)))
        out["code_blocks"] = kept("code_blocks", extract.in_sections(extract.extract_code_blocks(body).withColumn("line", F.col("start_line")), sections).drop("line"))
        stats = extract.document_stats(front, sections, out["links"], out["code_blocks"])
        out["documents"] = kept("documents", stats.join(front.select("path", "frontmatter", "tags", "mtime"), "path"))

    def postings() -> None:
        made = build_postings(sections)
        out["postings"] = kept("postings", with_levels(made["postings"]).sortWithinPartitions("term", "level"))
        out["stats"] = kept("stats", made["stats"])

    def ranking() -> None:
        postings()
        out["impacts"] = kept("impacts", impact_blocks(out["postings"]).sortWithinPartitions("term"))
        out["term_stats"] = kept("term_stats", out["impacts"].groupBy("term").agg(F.sum("n").alias("df")).sortWithinPartitions("term"))

    def vocabulary() -> None:
        out["words"] = kept("words", text_words(sections, "content", "section_id").select("word", "section_id").sortWithinPartitions("word"))
        out["vocabulary"] = kept("vocabulary", stem_vocabulary(out["words"]))
        out["lookups"] = kept("lookups", lookup_rows(spread(out["vocabulary"])).sortWithinPartitions("key", "word"))

    jobs = {"structure": structure, "ranking": ranking, "vocabulary": vocabulary, "postings": postings}
    with ThreadPoolExecutor(len(jobs)) as side_by_side:
        for job in [side_by_side.submit(jobs[part]) for part in parts]:
            job.result()
    return out


def index_vectors(index: dict[str, DataFrame], provider: Callable[[], EmbeddingProvider], folder: str, exclude: list[str] | None = None) -> vector_index.VectorIndex:
    """Embed the sections of an index (those with enough words, whose path no glob of ``exclude`` fits) and write the vectors
    as an inverted-file index, which semantic and hybrid searches look up."""
    some = index["sections"].filter(embedding.eligible(exclude)).select("section_id")
    texts = embedding.embedding_text(index["sections"], index["documents"]).join(some, "section_id", "left_semi")
    with passing() as keep:
        made = keep(embedding.embed(texts, provider))
        return vector_index.build(made.join(texts.select("section_id", "path", "heading"), "section_id"), folder)


def apply_changes(tables: dict[str, DataFrame], changes: DataFrame, corpus: DataFrame, preamble: bool = False) -> dict[str, DataFrame]:
    """Tables less what belongs to changed and deleted paths, plus what changed and new paths give. Unchanged documents
    are not read again."""
    gone = changes.filter(F.col("change").isin("changed", "deleted")).select("path")
    due = corpus.join(changes.filter(F.col("change").isin("changed", "new")).select("path"), "path", "left_semi")
    made = build_tables(due, preamble)
    return {k: t.join(gone, "path", "left_anti").unionByName(made[k].select(*t.columns)) for k, t in tables.items()}


def index_report(changes: DataFrame) -> DataFrame:
    """One row: indexed (new or changed), skipped (unchanged), deleted and total."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changes.agg(n("new", "changed").alias("indexed"), n("unchanged").alias("skipped"), n("deleted").alias("deleted"), n("new", "changed", "unchanged").alias("total"))


def heading_index(sections: DataFrame) -> DataFrame:
    """(heading, section_ids): lower-cased headings and their sections in order."""
    return sections.groupBy(F.lower("heading").alias("heading")).agg(F.sort_array(F.collect_list("section_id")).alias("section_ids"))


def heading_rows(sections: DataFrame) -> DataFrame:
    """(heading, section_id): the same as rows, sorted by both, so that a frequent heading is dealt over tasks."""
    return sections.select(F.lower("heading").alias("heading"), "section_id").orderBy("heading", "section_id")


def heading_counts(sections: DataFrame) -> DataFrame:
    """(heading, sections): how many sections a lower-cased heading has."""
    return sections.groupBy(F.lower("heading").alias("heading")).agg(F.count("*").alias("sections"))


def document_index(sections: DataFrame) -> DataFrame:
    """(path, section_ids) in order of the document."""
    return sections.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section_id"))), lambda x: x["section_id"]).alias("section_ids"))
