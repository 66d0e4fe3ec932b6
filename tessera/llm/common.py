"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as in the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Where no folder is named, a single machine (local tests) gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder; Spark removes the files when nothing refers to them."""
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as a compressed table in the shared folder, for more data; it stays until it is discarded."""
    path = f"{_shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    empty = [c for c, kind in df.dtypes if kind == "void"]  # Parquet has no such columns
    df.drop(*empty).write.parquet(path)
    out = df.sparkSession.read.schema(df.drop(*empty).schema).parquet(path)
    out = out.select(*(F.lit(None).alias(c) if c in empty else f"`{c}`" for c in df.columns)) if empty else out
    _paths[id(out)] = (out, path)
    if (mine := _run.get()) is not None:
        mine.append(out)
    return out


_paths: dict[int, tuple[DataFrame, str]] = {}
_run: ContextVar[list[DataFrame] | None] = ContextVar("tables of a run", default=None)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        _, path = _paths.pop(id(df))
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def own_tables() -> Iterator[list[DataFrame]]:
    """The tables that this thread writes meanwhile, for discard_but; those of other threads aren't among them. If the run
    fails, all are deleted."""
    mine: list[DataFrame] = []
    token = _run.set(mine)
    try:
        yield mine
    except BaseException:
        discard_but(None, mine)
        raise
    finally:
        _run.reset(token)


def discard_but(out: DataFrame | None, mine: list[DataFrame]) -> None:
    """Delete the tables of a run but for ``out``, once nothing reads them any more."""
    discard(*(df for df in mine if id(df) in _paths and df is not out))
    mine[:] = [] if out is None else [out]


def unlike(name: str, *taken: str) -> str:
    """The name, lengthened until no column of ``taken`` has it (names differ by more than case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose inner columns begin with two underscores: such columns of the given table go by other names inside."""

    @wraps(operator)
    def inner(df: DataFrame, *args, **kwargs) -> DataFrame:
        away = {c: unlike(f"own{c}", *df.columns) for c in df.columns if c.startswith("__")}
        if not away:
            return operator(df, *args, **kwargs)
        named = lambda x: away.get(x, x) if isinstance(x, str) else x
        out = operator(df.withColumnsRenamed(away), *map(named, args), **{k: named(x) for k, x in kwargs.items()})
        return out.withColumnsRenamed({v: k for k, v in away.items()})

    return inner


def bounded(path: str, most: int = 64 << 20) -> bytes:
    """The bytes of a model file for a broadcast; larger than ``most`` is an error."""
    if (size := os.path.getsize(path)) > most:
        raise ValueError(f"{path} has {size} bytes; at most {most} are broadcast")
    with open(path, "rb") as file:
        return file.read()


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte * base**place, and the inverse powers: (sums[e] - sums[b]) * down[b] names bytes b to e."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, A-Z lower-cased; equal words have equal hashes.

    Prefix sums give the hash of any stretch in constant time.
    """
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    sums, down = prefix_sums(_LOWER[data] if lower else data)
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _M1)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        out = mixed(out * _M1 + words[k : k + len(out)])
    return mixed(out + np.uint64(size))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    return run_hashes(words, min(size, len(words))) if len(words) else words
