"""Corpora from folders and tables, and the tables of an index on disk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.plans.patterns import IGNORED, ignored
from tessera.sources.scratch import stored

#: Files of ignore rules in a root, the later outranking the earlier. And the bytes read of one at most.
IGNORE_FILES, MOST_RULES = (".gitignore", ".mdmignore"), 1 << 20
#: Files of a folder that go to one task, and bytes of them that it holds at once (one file may be larger).
TASK_FILES, MOST_HELD = 4_000, 16 << 20


def read_corpus(spark: SparkSession, roots: str | list[str], exclude: list[str] | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES, empty: bool = False) -> DataFrame:
    """(path, text, mtime) of every .md and .mdx file below the roots; hidden files and folders, and files
    without a byte (unless ``empty``), are left out.

    ``path`` is relative to its root. Later rules outrank earlier: built-in ones, those of the root's ``ignore_files`` in
    their order, then ``exclude``.
    """
    found = None
    for root in [roots] if isinstance(roots, str) else roots:
        part = _files(spark, root, empty)
        rules = [*IGNORED, *(r for name in ignore_files for r in _rules(spark, f"{root.rstrip('/')}/{name}")), *(exclude or [])]
        part = filter_ignored(part.filter(~F.col("path").rlike(r"(?:^|/)\.")), rules)
        part = _texts(part, root) if "text" not in part.columns else part
        found = part if found is None else found.unionByName(part)
    return found


def _read_by_spark(spark: SparkSession, root: str, empty: bool = False) -> DataFrame:
    """(path, text, mtime) by Spark's reader: the driver lists the folder, and few files make a task."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").text(root, wholetext=True)
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = root.split("://", 1)[-1].rstrip("/")
    out = files.select(F.regexp_replace(full, f"^.*?{_literal(base)}/", "").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"))
    return out.unionByName(_empty_files(spark, root)) if empty else out


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, mtime) of the files without a byte, which Spark's reader leaves out; the driver lists the folder again."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, listed, rows = store.makeQualified(top).toUri().getPath().rstrip("/"), store.listFiles(top, True), []
    while listed.hasNext():
        file = listed.next()
        if not file.getLen():
            path = file.getPath().toUri().getPath()[len(base) + 1 :]
            hidden = any(p.startswith(".") or (p.startswith("_") and "=" not in p) for p in path.split("/"))
            if path.endswith((".md", ".mdx")) and not hidden:
                rows.append((path, file.getModificationTime()))
    return spark.createDataFrame(rows, "path string, ms long").select("path", F.lit("").alias("text"), F.timestamp_millis("ms").alias("mtime"))


def _files(spark: SparkSession, root: str, empty: bool = False) -> DataFrame:
    """(path, mtime) of the files below a root, listed by tasks, a level of folders at a time; of a root that is no folder of
    a store that Arrow knows, what Spark's reader has, with its text.

    As in Spark's reader, names that begin with . or _ (without =) are left out.
    """
    import pyarrow.fs

    try:
        store, base = pyarrow.fs.FileSystem.from_uri(root.rstrip("/") or "/")
        known = store.get_file_info(base).type == pyarrow.fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        known = False
    if not known:
        return _read_by_spark(spark, root, empty)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pyarrow.fs.FileSystem.from_uri(root.rstrip("/") or "/")
        for batch in batches:
            for folder in batch["path"]:
                at = f"{base.rstrip('/')}/{folder}".rstrip("/")
                rows = []
                for file in store.get_file_info(pyarrow.fs.FileSelector(at or "/")):
                    name = file.base_name
                    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
                    if not hidden and (not file.is_file or (name.endswith((".md", ".mdx")) and (empty or file.size))):
                        rows.append((f"{folder}/{name}".lstrip("/"), (file.mtime_ns or 0) // 1_000_000, not file.is_file))
                yield pd.DataFrame(rows, columns=["path", "ms", "folder"])

    cores = spark.sparkContext.defaultParallelism
    found, level = None, spark.createDataFrame([("",)], "path string")
    while True:
        level = stored(level.repartition(cores, "path").mapInPandas(listed, "path string, ms long, folder boolean"))
        files = level.filter("NOT folder").select("path", F.timestamp_millis("ms").alias("mtime"))
        found = files if found is None else found.unionByName(files)
        level = level.filter("folder").select("path")
        if level.isEmpty():
            return found


def _texts(files: DataFrame, root: str) -> DataFrame:
    """(path, text, mtime) of files that were listed: ``TASK_FILES`` of them go to a task."""
    import pyarrow.fs

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pyarrow.fs.FileSystem.from_uri(root.rstrip("/") or "/")
        for batch in batches:
            first, held, size = 0, [], 0
            for i, path in enumerate(batch["path"]):
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as file:
                    held.append(file.read())
                size += len(held[-1])
                if size > MOST_HELD or i == len(batch) - 1:
                    yield pd.DataFrame({"path": batch["path"].iloc[first : i + 1], "bytes": held, "mtime": batch["mtime"].iloc[first : i + 1]})
                    first, held, size = i + 1, [], 0

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // TASK_FILES))
    rows = files.repartition(tasks, "path").mapInPandas(read, "path string, bytes binary, mtime timestamp")
    return rows.select("path", F.col("bytes").cast("string").alias("text"), "mtime")


def write_folder(corpus: DataFrame, folder: str) -> None:
    """Write each (path, text) as a file below a folder that the driver and all tasks share; a null text is an empty file.

    With a column ``op``, files of rows whose op is delete are deleted instead.
    """
    import pyarrow.fs

    store, root = pyarrow.fs.FileSystem.from_uri(folder)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = pyarrow.fs.FileSystem.from_uri(folder)[0]
        made = set()
        for batch in batches:
            for path, text, op in zip(batch["path"], batch["text"], batch["op"]):
                name = f"{root}/{path}"
                if op == "delete":
                    to.delete_file(name)
                    continue
                if (parent := name.rpartition("/")[0]) not in made:
                    to.create_dir(parent, recursive=True)
                    made.add(parent)
                with to.open_output_stream(name) as out:
                    out.write((text or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    store.create_dir(root, recursive=True)
    op = F.col("op") if "op" in corpus.columns else F.lit("add")
    corpus.select("path", "text", op.alias("op")).mapInPandas(written, "n long").agg(F.sum("n")).collect()


def _rules(spark: SparkSession, file: str) -> list[str]:
    """The lines of a small file of rules; none where there is no such file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    stream = store.open(path)
    try:
        return bytes(stream.readNBytes(MOST_RULES)).decode("utf-8", "replace").splitlines()
    finally:
        stream.close()


def _literal(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def filter_ignored(df: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Rows whose path the patterns, in order of rising priority, don't ignore."""
    return df.filter(~ignored(F.col(path), patterns))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores where an input has fewer splits than there are cores, as small tables do; else as they
    are: then nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus_from_table(df: DataFrame, path: Column | str, text: Column | str, mtime: Column | None = None) -> DataFrame:
    """Any table as a corpus: (path, text, mtime)."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(path).alias("path"), as_column(text).alias("text"), (mtime if mtime is not None else F.lit(None)).cast("timestamp").alias("mtime"))


def save_index(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Write each table of an index below the folder."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def load_index(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(schemas.TABLES)) -> dict[str, DataFrame]:
    """The tables of an index; one whose columns aren't those of its schema is an error."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        have = dict(df.dtypes)
        want = dict(spark.createDataFrame([], (schemas.TABLES | schemas.SEARCH_TABLES)[name]).dtypes)
        if wrong := {k: v for k, v in want.items() if have.get(k) != v}:
            raise ValueError(f"{folder}/{name}: columns missing or of another type: {wrong}")
        out[name] = df
    return out


def save_vectors(vectors: DataFrame, folder: str, mode: str = "append") -> None:
    """Vectors in a folder of their own for each namespace."""
    vectors.write.mode(mode).partitionBy("namespace").parquet(f"{folder}/vectors.parquet")


def load_vectors(spark: SparkSession, folder: str, namespace: str, dims: int) -> DataFrame:
    """The vectors of one namespace (no other is read); any of another dimension is an error."""
    df = spark.read.parquet(f"{folder}/vectors.parquet").filter(F.col("namespace") == namespace)
    odd = df.filter(F.size("embedding") != dims).limit(1).select(F.size("embedding").alias("n")).collect()
    if odd:
        raise ValueError(f"namespace {namespace} holds vectors of {odd[0]['n']} dimensions, not {dims}")
    return df


#: Where an index folder has its vectors, as vector_index.build writes them.
VECTOR_INDEX = "vectors"


def detect_modes(spark: SparkSession, folder: str) -> dict[str, object]:
    """Which of postings and vectors an index folder has, and the mode to use."""

    def exists(name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    bm25, vectors = exists("postings.parquet"), exists("vectors.parquet") or exists(f"{VECTOR_INDEX}/centroids/_SUCCESS")
    return {"bm25": bm25, "vectors": vectors, "recommended": "hybrid" if bm25 and vectors else "semantic" if vectors else "keyword"}
