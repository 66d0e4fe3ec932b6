"""What surrounds an embedding model: its inputs, what is due, batches, cost, namespaces."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.bm25 import LEAST_TOKENS
from tessera.plans.patterns import path_matches

#: Texts in a request, tries of it, and the seconds that 100 sections are said to take.
BATCH, TRIES, SECONDS = 100, 5, 1.5
#: Native dimensions of known models, those of them that can be reduced, and what to reduce them to.
NATIVE = {
    "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536,
    "nomic-embed-text": 768, "mxbai-embed-large": 1024, "bge-m3": 1024, "all-minilm": 384, "snowflake-arctic-embed": 1024,
    "voyage-3.5-lite": 1024, "voyage-3": 1024, "voyage-code-3": 1024, "voyage-2": 1024, "voyage-large-2": 1536, "voyage-code-2": 1536,
}
REDUCIBLE, REDUCED = ("text-embedding-3-small", "text-embedding-3-large"), 512


class EmbeddingProvider(Protocol):
    """Anything that turns texts into vectors and says how many tokens it used."""

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]: ...


class HashingProvider:
    """A deterministic provider for tests: signed counts of hashed words, of length 1."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]:
        out, tokens = [], 0
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
                tokens += 1
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out, tokens


def embedding_text(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(section_id, path, heading, text): heading, the last earlier heading one level up, title, blank line, content."""
    w = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    above = F.lit(None).cast("string")
    for level in range(2, 7):
        above = F.when(F.col("level") == level, F.last(F.when(F.col("level") == level - 1, F.col("heading")), ignorenulls=True).over(w)).otherwise(above)
    own = sections.withColumn("context_heading", above).join(documents.select("path", "title"), "path", "left")
    head = F.concat_ws("\n", "heading", "context_heading", "title")
    return own.select("section_id", "path", "heading", F.concat(head, F.lit("\n\n"), F.col("content")).alias("text"))


def eligible(exclude: list[str] | None) -> Column:
    """Sections of enough words, whose path no glob fits."""
    out = F.col("token_count") >= LEAST_TOKENS
    for glob in exclude or []:
        out &= ~path_matches(F.col("path"), glob)
    return out


def embedding_delta(sections: DataFrame, vectors: DataFrame, exclude: list[str] | None = None, parity: bool = False) -> dict[str, DataFrame]:
    """``due``: eligible sections without a vector; ``stale``: vectors without an eligible section. Keyed by (section_id,
    content_hash), so that edited sections are due; by the id alone with ``parity``."""
    keys = ["section_id"] if parity else ["section_id", "content_hash"]
    some = sections.filter(eligible(exclude))
    return {"due": some.join(vectors.select(*keys), keys, "left_anti"), "stale": vectors.join(some.select(*keys), keys, "left_anti")}


def asked_again(provider: EmbeddingProvider, texts: list[str], tries: int, wait: float) -> tuple[list[list[float]], int]:
    """What a provider says; a failed request is tried again after twice the wait."""
    for attempt in range(tries):
        try:
            return provider.embed(texts)
        except (ConnectionError, TimeoutError):
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("at least one try is needed")


def embed(df: DataFrame, provider: Callable[[], EmbeddingProvider], batch_size: int = BATCH, tries: int = TRIES, wait: float = 0.5) -> DataFrame:
    """(section_id, embedding, tokens) of (section_id, text). ``provider`` makes a provider once in each task; a failed
    request is tried again after twice the wait. A batch's tokens stand in its first row."""

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = provider()
        for pdf in batches:
            for first in range(0, len(pdf), batch_size):
                part = pdf.iloc[first : first + batch_size]
                vectors, tokens = asked_again(own, part["text"].tolist(), tries, wait)
                yield pd.DataFrame({"section_id": part["section_id"], "embedding": vectors, "tokens": [tokens] + [0] * (len(part) - 1)})

    kind = df.schema["section_id"].dataType.simpleString()
    return df.select("section_id", "text").mapInPandas(embedded, f"section_id {kind}, embedding array<float>, tokens long")


def embedding_cost(sections: DataFrame, price_per_million: float = 0.02) -> DataFrame:
    """(directory, files, sections, tokens, cost) of eligible sections, one row for each directory."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = sections.filter(eligible(None)).groupBy(F.when(folder == "", ".").otherwise(folder).alias("directory"))
    return own.agg(F.count_distinct("path").alias("files"), F.count("*").alias("sections"), F.sum("token_count").alias("tokens")).withColumn("cost", F.col("tokens") * price_per_million / 1e6)


def embedding_cost_total(costs: DataFrame) -> DataFrame:
    """One row: files, sections, tokens, cost and the seconds that embedding takes."""
    out = costs.agg(*(F.sum(c).alias(c) for c in ("files", "sections", "tokens", "cost")))
    return out.withColumn("seconds", F.ceil(F.col("sections") / 100) * SECONDS)


def namespace(provider: Column, model: Column, dims: Column) -> Column:
    return F.regexp_replace(F.lower(F.concat_ws("_", provider, model, dims.cast("string"))), r"[^a-z0-9_.-]", "-")


def namespaces(vectors: DataFrame) -> DataFrame:
    """(namespace, vectors, dims, updated), newest first where an ``updated`` time is known."""
    when = F.max("updated") if "updated" in vectors.columns else F.lit(None).cast("timestamp")
    return vectors.groupBy("namespace").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"), when.alias("updated")).orderBy(F.desc_nulls_last("updated"), "namespace")


def vector_stats(vectors: DataFrame, price_per_million: float = 0.02) -> DataFrame:
    """(namespace, vectors, dims, tokens, cost)."""
    out = vectors.groupBy("namespace").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"), F.sum("tokens").alias("tokens"))
    return out.withColumn("cost", F.col("tokens") * price_per_million / 1e6)


def check_dimensions(df: DataFrame) -> DataFrame:
    """Add native, ok and recommended to (model, dims): reducible models take fewer dimensions than their own."""
    known = df.sparkSession.createDataFrame(list(NATIVE.items()), "model string, native int")
    reducible = F.col("model").isin(*REDUCIBLE)
    out = df.join(F.broadcast(known), "model", "left")
    ok = (F.col("dims") == F.col("native")) | (reducible & F.col("dims").between(1, F.col("native")))
    return out.withColumns({"ok": F.coalesce(ok, F.lit(False)), "recommended": F.when(reducible, REDUCED).otherwise(F.col("native"))})
