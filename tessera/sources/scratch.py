"""Folders and tables that live as long as a run."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the session shares (spark.checkpoint.dir); on a single machine, a temporary one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/index-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-index-")


def stored(df: DataFrame) -> DataFrame:
    """The same as a table in a folder of its own, worked out once; for results that are read later."""
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    root = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{root}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/table"), root


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``stored`` for tables that nothing reads after the block, where they are deleted."""
    made: list[tuple[DataFrame, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(_stored(df))
        return made[-1][0]

    try:
        yield keep
    finally:
        for df, root in made:
            delete(df.sparkSession, root)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path, store = _path(spark, folder)
    store.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path, store = _path(spark, folder)
    return store.exists(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is in a folder; none where there is no such folder."""
    path, store = _path(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []
