"""Embeddings that are asked for once: each batch of results is committed as it comes, under the hash of its texts.

Texts are known by their content, so equal ones are embedded once, and those in the store not at all. What is missing is
dealt to tasks by its hash and batched in order, so that a task which is run anew has the batches of its first attempt:
those that were committed before it failed are found by name, and the provider isn't called for them. A later run joins the
texts with the store first and asks for what is still missing alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.embedding import BATCH, TRIES, EmbeddingProvider, asked_again
from tessera.sources.scratch import children

ROWS = pa.schema({"content_hash": pa.string(), "embedding": pa.list_(pa.float32()), "tokens": pa.int64()})
STORE = "content_hash string, embedding array<float>, tokens long"


def _key(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def known(spark: SparkSession, folder: str, namespace: str) -> DataFrame:
    """(content_hash, embedding, tokens): what the store has; a batch's tokens stand in its first row."""
    place = f"{folder}/{namespace}"
    return spark.read.schema(STORE).parquet(place) if children(spark, place) else spark.createDataFrame([], STORE)


def _committed(place: str, key: str, make: Callable[[], pa.Table]) -> bool:
    """Write a batch under its name, whole or not at all; false if it is there."""
    store, root = pyarrow.fs.FileSystem.from_uri(place)
    name = f"{root}/{key}.parquet"
    if store.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
        return False
    table = make()
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{key}-{uuid.uuid4().hex}"  # names with a dot are no part of a table
    pyarrow.parquet.write_table(table, draft, filesystem=store)
    store.move(draft, name)
    return True


def fill(df: DataFrame, provider: Callable[[], EmbeddingProvider], folder: str, namespace: str, batch_size: int = BATCH, tries: int = TRIES, wait: float = 0.5) -> dict[str, int]:
    """Embed the texts that the store of (folder, namespace) lacks; how many texts and tokens the provider was asked for.

    ``folder`` is one that the driver and all tasks share. A null text is empty.
    """
    spark = df.sparkSession
    place = f"{folder}/{namespace}"
    texts = df.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("content_hash", _key(F.col("text"))).dropDuplicates(["content_hash"])
    due = texts.join(known(spark, folder, namespace).select("content_hash"), "content_hash", "left_anti")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = None, []
        asked = tokens = 0

        def sent(part: list[tuple[str, str]]) -> None:
            nonlocal own, asked, tokens

            def make() -> pa.Table:
                nonlocal own, asked, tokens
                own = own or provider()
                vectors, used = asked_again(own, [t for _, t in part], tries, wait)
                asked, tokens = asked + len(part), tokens + used
                return pa.Table.from_pydict({"content_hash": [h for h, _ in part], "embedding": vectors, "tokens": [used] + [0] * (len(part) - 1)}, schema=ROWS)

            _committed(place, hashlib.sha256("".join(h for h, _ in part).encode()).hexdigest(), make)

        for pdf in batches:
            held += zip(pdf["content_hash"], pdf["text"])
            while len(held) >= batch_size:  # batches don't depend on how rows come
                sent(held[:batch_size])
                held = held[batch_size:]
        if held:
            sent(held)
        yield pd.DataFrame({"asked": [asked], "tokens": [tokens]})

    dealt = due.select("content_hash", "text").repartition(n, "content_hash").sortWithinPartitions("content_hash")
    told = dealt.mapInPandas(embedded, "asked long, tokens long").agg(F.sum("asked").alias("asked"), F.sum("tokens").alias("tokens")).first()
    return {"asked": told["asked"] or 0, "tokens": told["tokens"] or 0}


def embed_once(df: DataFrame, provider: Callable[[], EmbeddingProvider], folder: str, namespace: str, **options) -> DataFrame:
    """(section_id, embedding) of (section_id, text), from the store after it is filled with what it lacks."""
    fill(df, provider, folder, namespace, **options)
    store = known(df.sparkSession, folder, namespace).select("content_hash", "embedding").dropDuplicates(["content_hash"])
    return df.select("section_id", _key(F.col("text")).alias("content_hash")).join(store, "content_hash").select("section_id", "embedding")
