"""The link graph: an edge table, and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(path: Column, href: Column) -> Column:
    """The path, relative to the corpus, that an internal link names; null for absolute ones and for those that leave it."""
    target = F.regexp_replace(href, r"#.*$", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    step = lambda s, part: F.when(s.isNull() | (part == "") | (part == "."), s).when(part != "..", F.concat(s, F.array(part))).when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.lit(None).cast("array<string>"))
    parts = F.aggregate(F.split(F.concat(folder, target), "/"), F.array().cast("array<string>"), step)
    return F.when(F.startswith(href, F.lit("#")), path).when(F.startswith(href, F.lit("/")), None).otherwise(F.nullif(F.array_join(parts, "/"), F.lit("")))


def resolve_links(links: DataFrame) -> DataFrame:
    """Add target to each link (null unless internal)."""
    return links.withColumn("target", F.when(F.col("link_type") == "internal", resolved(F.col("path"), F.col("href"))))


def outgoing_links(links: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, line, target) of resolved links, repeats included, of the given paths or of all."""
    own = links.filter("target IS NOT NULL").select("path", "line", "target")
    return own if paths is None else own.join(paths.select("path").distinct(), "path", "left_semi")


def backlinks(links: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(target, path): the distinct documents that link to each target."""
    own = links.filter("target IS NOT NULL").select("target", "path").distinct()
    return own if paths is None else own.join(paths.select(F.col("path").alias("target")).distinct(), "target", "left_semi")


def broken_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, target) of links to documents that don't exist."""
    return links.filter("target IS NOT NULL").select("path", "target").distinct().join(documents.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target")


def link_degrees(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, out_degree, in_degree, orphan) of every document, each neighbour counted once."""
    edges = links.filter("target IS NOT NULL").select("path", "target").distinct()
    out = edges.groupBy("path").agg(F.count("*").alias("out_degree"))
    into = edges.groupBy("target").agg(F.count("*").alias("in_degree")).withColumnRenamed("target", "path")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = documents.select("path").join(out, "path", "left").join(into, "path", "left").select("path", zero("out_degree"), zero("in_degree"))
    return own.withColumn("orphan", (F.col("out_degree") == 0) & (F.col("in_degree") == 0))
