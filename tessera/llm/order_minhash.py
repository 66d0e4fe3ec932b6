"""Document fingerprints by Order MinHash (after Marçais, DeBlasio, Pandey and Kingsford, 2019).

A text's k-mers of code points are numbered by occurrence, so that the second "the cat" differs from the first. Each of
``ENTRIES`` permutations orders these pairs; the ``TOGETHER`` smallest are put back into text order, and the hash of the
k-mers in that order is one entry of the fingerprint. Plain MinHash sees which k-mers two texts share; here an entry also
changes when shared k-mers stand in another order, so the share of equal entries follows the edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mixed, prefix_sums, unlike

#: Code points of a k-mer, entries of a fingerprint, and k-mers that make one entry.
K, ENTRIES, TOGETHER = 8, 64, 2
#: K-mers that go through all permutations at once: what a task needs doesn't depend on a text's k-mers times entries.
BLOCK = 2048
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MOST = np.uint32(0xFFFFFFFF)


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` code points; of the whole text if it is shorter. Its high bits are the better ones."""
    k = min(k, len(points))
    sums, down = prefix_sums(points)
    return (sums[k:] - sums[: len(sums) - k]) * down[: len(points) - k + 1]


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each one."""
    out = np.zeros(len(hashes), np.uint64)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    short = lambda h: (h * _STEP) >> np.uint64(48)
    marked = np.zeros(1 << 16, bool)
    marked[short(twice)] = True
    rows = np.flatnonzero(marked[short(hashes)])  # all hashes that come twice, and a few more
    order = np.argsort(hashes[rows], kind="stable")
    some = hashes[rows][order]
    begins = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
    out[rows[order]] = np.arange(len(rows)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(rows)]))))
    return out


class Permutations:
    """Pseudo-random orders of well-mixed 32-bit numbers: a product with an odd number, by entry another one."""

    def __init__(self, entries: int = ENTRIES, together: int = TOGETHER, k: int = K):
        drawn = mixed(mixed(np.arange(1, entries + 1, dtype=np.uint64) * _STEP))
        self.odd = (drawn >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.entries, self.together, self.k = entries, together, k
        self.rows, self.room = np.arange(entries), np.empty(entries * BLOCK, np.uint32)

    def lowest(self, pairs: np.ndarray, begin: int, end: int, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The smallest values of each permutation among the pairs at ``begin`` to ``end`` and those ``found`` before them,
        and where they stand."""
        values, places = found or (np.zeros((self.entries, 0), np.uint32), np.zeros((self.entries, 0), np.int64))
        for at in range(begin, end, BLOCK):
            part = pairs[at : min(end, at + BLOCK)]
            room = self.room[: self.entries * len(part)].reshape(self.entries, len(part))
            np.multiply(part, self.odd, out=room)
            take = min(self.together, len(part))
            new, where = np.empty((self.entries, take), np.uint32), np.empty((self.entries, take), np.int64)
            for j in range(take):
                low = where[:, j] = room.argmin(axis=1)
                new[:, j] = room[self.rows, low]
                room[self.rows, low] = _MOST
            where += at
            if values.shape[1]:
                new, where = np.concatenate((values, new), axis=1), np.concatenate((places, where), axis=1)
                best = np.argsort(new, axis=1, kind="stable")[:, : self.together]
                new, where = new[self.rows[:, None], best], where[self.rows[:, None], best]
            values, places = new, where
        return values, places

    def entries_of(self, hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The chosen k-mers of each permutation in text order, hashed as a tuple."""
        out = np.zeros(self.entries, np.uint64)
        for column in np.sort(places, axis=1).T:
            out = mixed(out * _STEP + hashes[column])
        return (mixed(out) >> np.uint64(32)).astype(np.uint32)

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """A 32-bit number for each (k-mer, occurrence)."""
        x = hashes + occurrences(hashes) * _STEP
        x ^= x >> np.uint64(32)
        x *= _SPREAD
        return (x >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self, text: str) -> np.ndarray:
        hashes = kmers(_points(text), self.k)
        return self.entries_of(hashes, self.lowest(self.pairs(hashes), 0, len(hashes))[1])

    def both(self, text: str, edited: str, shared: int) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints of a text and of another one that begins with the same ``shared`` code points.

        K-mers within the common beginning are the same, with the same numbers; they are put in order once.
        """
        if text == edited:
            return (own := self.fingerprint(text)), own
        common = max(0, shared - self.k + 1) if min(len(text), len(edited)) >= self.k else 0
        hashes = kmers(_points(text), self.k)
        rest = edited[common:]
        hashes2 = np.concatenate((hashes[:common], kmers(_points(rest), self.k))) if not common or len(rest) >= self.k else hashes[:common]
        pairs, pairs2 = self.pairs(hashes), self.pairs(hashes2)
        begun = self.lowest(pairs, 0, common)
        return self.entries_of(hashes, self.lowest(pairs, common, len(pairs), begun)[1]), self.entries_of(hashes2, self.lowest(pairs2, common, len(pairs2), begun)[1])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def as_hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def with_fingerprint(df: DataFrame, text: str = "text", entries: int = ENTRIES, together: int = TOGETHER, k: int = K) -> DataFrame:
    """Add ``fingerprint``: eight hexadecimal digits for each of ``entries`` entries.

    A null text is empty; an empty text and one of fewer than ``k`` code points are a single k-mer. Equal texts have equal
    fingerprints. Other columns are kept, one named ``fingerprint`` is replaced, and an empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sketch = Permutations(entries, together, k)
        for texts in batches:
            yield pd.Series([as_hex(sketch.fingerprint(t)) for t in texts], dtype="object")

    return df.withColumn("fingerprint", made(F.coalesce(F.col(text), F.lit(""))))


def likeness(a: Column, b: Column, entries: int = ENTRIES) -> Column:
    """The share of equal entries of two fingerprints, 0 to 1."""
    equal = lambda i: F.when(F.substr(a, 8 * i + 1, F.lit(8)) == F.substr(b, 8 * i + 1, F.lit(8)), 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(entries - 1)), F.lit(0), lambda n, i: n + equal(i)) / F.lit(float(entries))


def in_order(df: DataFrame, id_col: str, text: str, partitions: int) -> DataFrame:
    """Rows (id, text, again) dealt by ranges of (id, hash of the text), in that order within each partition; the first row
    of the range after it (after the last range: of the first) ends each partition, with ``again`` true.

    The borders come from a shuffle of ids and hashes alone, so texts are shuffled once.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.struct("id", F.xxhash64("text").alias("hash")))
    ranges = rows.select("key").repartitionByRange(partitions, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first"))
    firsts = [r["first"] for r in ranges.orderBy("p").collect()]  # a row for each partition
    n = max(1, len(firsts))
    kind = rows.schema["id"].dataType
    known = F.array(*(F.struct(F.lit(f["id"]).cast(kind).alias("id"), F.lit(f["hash"]).cast("long").alias("hash")) for f in firsts))
    at = F.size(F.filter(known, lambda f: f <= F.col("key"))) - 1
    begins = F.exists(known, lambda f: f == F.col("key"))
    here = F.struct(F.col("at").alias("p"), F.lit(False).alias("again"))
    there = F.when(begins, F.array(here, F.struct(F.pmod(F.col("at") - 1, F.lit(n)).alias("p"), F.lit(True).alias("again")))).otherwise(F.array(here))
    if not firsts:
        return rows.select("id", "text", F.lit(False).alias("again"))
    dealt = rows.withColumn("at", at).select("id", "text", F.col("key")["hash"].alias("hash"), F.explode(there).alias("to"))
    return dealt.repartitionById(n, F.col("to")["p"]).sortWithinPartitions(F.col("to")["again"], "id", "hash", "text").select("id", "text", F.col("to")["again"].alias("again"))


def compare_edits(df: DataFrame, id_col: str = "doc_id", text: str = "text", partitions: int | None = None, share: int = 4) -> DataFrame:
    """Fingerprints of each text and of the text with its last ``share``-th part replaced from the next document.

    Documents stand in order of their id, nulls first; rows of one id in order of their texts' hashes. The last floor(n_chars /
    ``share``) code points are replaced by the first as many (or all) of the next document, after the last one by those of
    the first. Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: the
    likeness of the text's fingerprint to those of the edited text and of the next document. A null text is empty. Repeated
    rows are compared each, with the row that follows. Only these columns are returned. An empty table gives an empty one.

    Texts are shuffled once, by ranges of ids; a task holds two documents at a time beside Spark's batch.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    id_name = unlike(id_col, *names[1:])

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, held, waiting = Permutations(), None, None

        def neighbours(batch: pd.DataFrame) -> Iterator[tuple]:
            """(id, text, text of the next document)"""
            nonlocal held
            for key, body, again in zip(batch["id"].astype(object).where(batch["id"].notna(), None), batch["text"], batch["again"]):
                if held is not None:
                    yield (*held, body)
                held = None if again else (key, body)

        def told(batch: pd.DataFrame) -> Iterator[tuple]:
            """A row is told when its next document is compared, which makes that one's fingerprint."""
            nonlocal waiting
            for key, body, after in neighbours(batch):
                cut = len(body) // share
                edited = body[: len(body) - cut] + after[:cut]
                own, other = sketch.both(body, edited, len(body) - cut)
                if waiting is not None:
                    yield (*waiting[0], float((waiting[1] == own).mean()))
                waiting = (key, len(body), hashlib.sha256(edited.encode("utf-8")).hexdigest(), as_hex(own), as_hex(other), float((own == other).mean())), own, after

        for batch in batches:
            yield pd.DataFrame(told(batch), columns=[id_name, *names[1:]])
        if waiting is not None:  # what follows the partition's last document is the row that stands there again
            row, own, after = waiting
            yield pd.DataFrame([(*row, float((own == sketch.fingerprint(after)).mean()))], columns=[id_name, *names[1:]])

    schema = f"`{id_name}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(df, id_col, text, n).mapInPandas(compared, schema)
