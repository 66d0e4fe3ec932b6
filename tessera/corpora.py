"""The given tables as corpora of Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.corpus import corpus_from_table, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each conversation, a section for each turn."""
    # a fixed number of partitions: merged ones, small in bytes, would leave extraction to few cores
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    turns = table(spark, sf_dir, "conversations").repartition(n, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    part = lambda t: F.concat(F.lit("\n\n## "), t["role"], F.lit("\n\n"), t["text"])
    text = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.array_join(F.transform("turns", part), ""))
    return corpus_from_table(turns, F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")), text)


def rich_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as Markdown with nested headings, a list, its text in a fence, a table, and in every second a further
    heading with inline markup."""
    i = F.col("doc_id").cast("string")
    more = F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n# Second\n\nend **bold** and `code` [link](x.md)")).otherwise("")
    text = F.concat(F.lit("# Guide "), i, F.lit("\n\nIntro of "), "source", F.lit("\n\n## Steps\n\n- one "), "lang", F.lit("\n- two\n\n#### Deep\n\n`````txt\n"), "text", F.lit("\n`````\n\n### Back\n\n| a | b |\n| - | - |\n| "), i, F.lit(" | 2 |"), more)
    return corpus_from_table(spread(table(spark, sf_dir, "documents")), F.concat("source", F.lit("/"), i, F.lit(".md")), text)


def doc_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are; they have no headings."""
    return corpus_from_table(spread(table(spark, sf_dir, "documents")), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), "text")


def doc_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, with the path and the first line of the document of the same number where there is one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.trim(F.split("text", "\n")[0]).alias("heading"))
    return table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left").select(F.col("vec_id").alias("section_id"), "path", "heading", "embedding", F.lit("given_64").alias("namespace"))


def page_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(links, documents) of the pages: paths are host and path of the url, root-relative hrefs become host and href."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    path = F.concat(host, F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("line", "href"))
    target = F.when(F.startswith("href", F.lit("/")), F.concat("host", "href"))
    return own.select("path", "line", F.lit("internal").alias("link_type"), "href", target.alias("target")), pages.select(path.alias("path")).distinct()


def feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a corpus: the second drops, edits and adds documents."""
    docs = spread(table(spark, sf_dir, "documents"))
    rest = F.pmod("doc_id", F.lit(10))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))
    stamp = lambda c: F.timestamp_seconds(c)
    one = docs.filter(rest < 8).select(path.alias("path"), "text", stamp(F.lit(0)).alias("mtime"))
    edited = F.when(rest == 1, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    two = docs.filter(rest > 0).select(path.alias("path"), edited.alias("text"), stamp(F.when(rest == 1, 60).otherwise(0)).alias("mtime"))
    return one, two
