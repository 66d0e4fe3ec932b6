"""Similarity join of documents on word shingles by parity sketches.

A shingle flips one bit of a document's sketch, so the Hamming distance of two sketches never exceeds the symmetric
difference of the sets; a Jaccard similarity of 3/4 bounds that by a seventh of both sizes together. Sketches serve twice.

 * Pigeonhole join. A long sketch is cut into blocks, each known by the XOR of the 64-bit names of its odd bits. Sets that
   differ in d shingles differ in at most d blocks, so sets of a size band that may be linked share a block that isn't
   empty. Up to ``SMALL`` shingles a block is one shingle, and the first n // 4 + 1 in order of hash must share one. Above,
   bands double in size; a band of least size L has L blocks, of which the first ``BLOCKS`` are looked at, a sample of hash
   space: for a pair at the threshold each is alike and not empty with a chance over 0.41, so that none of 56 is with a
   chance below 1e-12. Documents that share a block meet in a bucket.
 * Rejection. A short sketch of 1024 bits, doubled with each band, travels to the buckets. A pair whose Hamming distance is
   over the bound is no link, exactly; what passes has a similarity of about 0.73 or more, and is verified on the texts.

Meetings stay linear: each document is first compared with the smallest one that opens a bucket of its own. Then the buckets
whose members are in different components are looked at in tiles of bounded size, and a tile emits only as many pairs as
join its components; a bucket of which a pair fails verification is looked at once more for all pairs that are left. So
neither groups of copies nor documents around a common passage emit their square, and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, checkpointed, discard, mixed, shingle_hashes, word_hashes, written
from tessera.llm.components import components

SHINGLE, SMALL, BLOCKS = 5, 64, 56
#: The threshold as a fraction: OVER * intersection >= UNDER * union.
OVER, UNDER = 100, 75
#: Members of a tile, rows that are broadcast at most, and bits of the shortest sketch.
TILE, MOST_BROADCAST, BITS = 4096, 1_000_000, 1024
_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_set(text: str) -> np.ndarray:
    """Hashes of the distinct shingles in order."""
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8")), SHINGLE))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are similar enough."""
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OVER * common >= UNDER * (len(a) + len(b) - common)


def block_keys(s: np.ndarray, blocks: int | None = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of a set, and whether each is of the band of its own size (else of the band below).

    Of a band's blocks the first ``blocks`` are looked at; none: all.
    """
    n, keys, own = len(s), [], []
    if 0 < n <= SMALL * 4 // 3:
        first = mixed(s[: n // 4 + 1] ^ _SALT)
        keys.append(first)
        own.append(np.full(len(first), n <= SMALL))
    if n > SMALL:
        band = int(n // (SMALL + 1)).bit_length() - 1
        bands = [band] if band == 0 or 3 * n > 4 * ((SMALL + 1) << band) else [band, band - 1]
        for j in bands:
            block = s % np.uint64((SMALL + 1) << j)
            inside = block < (blocks or (SMALL + 1) << j)
            block, value = block[inside], s[inside]
            order = np.argsort(block, kind="stable")
            block, value = block[order], value[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
            parity = np.bitwise_xor.reduceat(value, first) if len(first) else value
            keys.append(mixed(parity ^ mixed(block[first] + (np.uint64(j + 1) << np.uint64(48)) + _SALT)))
            own.append(np.full(len(first), j == band))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(own)


def digest(s: np.ndarray) -> bytes:
    """The name of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set as 64-bit words: each shingle flips a bit."""
    size = BITS << max(0, int(len(s) // (SMALL + 1)).bit_length() - 1)
    odd = np.bincount((s >> np.uint64(32)) & np.uint64(size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The same set's sketch of fewer words."""
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def may_link(na: int, sa: np.ndarray, nb: int, sb: np.ndarray) -> bool:
    """Whether two sets may be linked by their sizes and sketches; all that are do."""
    if min(na, nb) * OVER < max(na, nb) * UNDER:
        return False
    size = min(len(sa), len(sb))
    apart = int(np.bitwise_count(folded(sa, size) ^ folded(sb, size)).sum())
    return apart * (OVER + UNDER) <= (na + nb) * (OVER - UNDER)


def close_pairs(n: np.ndarray, sketches: list[np.ndarray], group: np.ndarray, side: np.ndarray | None = None, brief: bool = False) -> list[tuple[int, int]]:
    """Pairs of rows that may be linked and are of different groups (and sides).

    ``brief``: two groups count as one once they have a pair, so that there are fewer pairs than rows.
    """
    size = min(map(len, sketches))
    words, group, out = np.stack([folded(s, size) for s in sketches]), group.copy(), []
    for r in range(len(n) - 1):
        other = np.flatnonzero(group[r + 1 :] != group[r]) + r + 1
        if side is not None:
            other = other[side[other] != side[r]]
        other = other[np.minimum(n[other], n[r]) * OVER >= np.maximum(n[other], n[r]) * UNDER]
        if not len(other):
            continue
        apart = np.bitwise_count(words[other] ^ words[r]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart * (OVER + UNDER) <= (n[other] + n[r]) * (OVER - UNDER))
        for x in other[near[np.argsort(apart[near], kind="stable")]].tolist():
            if not brief:
                out.append((r, x))
            elif group[x] != group[r]:
                out.append((r, x))
                group[group == group[x]] = group[r]
    return out


def _sketched(batches: Iterator[pd.DataFrame], blocks: int | None = BLOCKS) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n, names, keys, own, sketches = [], [], [], [], []
        for text in batch["text"]:
            s = shingle_set(text)
            k, o = block_keys(s, blocks)
            n.append(len(s))
            names.append(digest(s))
            keys.append(k.tobytes())
            own.append(o.tobytes())
            sketches.append(sketch(s).tobytes())
        yield pd.DataFrame({"id": batch["id"], "n": n, "digest": names, "keys": keys, "own": own, "sketch": sketches})


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [may_link(na, np.frombuffer(sa, np.uint64), nb, np.frombuffer(sb, np.uint64)) for na, sa, nb, sb in zip(batch["na"], batch["sa"], batch["nb"], batch["sb"])]
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def _tiles(batches: Iterator[pd.DataFrame], brief: bool) -> Iterator[pd.DataFrame]:
    """Pairs of each tile, or of two tiles of a bucket; a tile's rows come one after another."""
    names = ["key", "x", "y", "cls", "n", "c", "own_tile"]

    def told(parts: list[tuple[np.ndarray, list[bytes]]]) -> list[tuple[int, int, int]]:
        rows = np.concatenate([p for p, _ in parts]) if len(parts) > 1 else parts[0][0]
        key, x, y = rows[0, :3].tolist()
        side = None if x == y else rows[:, 6] == y
        cls = rows[:, 3].tolist()
        found = close_pairs(rows[:, 4], [np.frombuffer(s, np.uint64) for _, own in parts for s in own], rows[:, 5], side, brief)
        return [(key, min(cls[i], cls[k]), max(cls[i], cls[k])) for i, k in found]

    waiting: list[tuple[np.ndarray, list[bytes]]] = []
    for batch in batches:
        rows, sketches, out = batch[names].to_numpy(np.int64), batch["sketch"].tolist(), []
        cut = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1).tolist(), len(rows)]
        for first, last in zip(cut, cut[1:]):
            if waiting and (waiting[0][0][0, :3] != rows[first, :3]).any():
                out += told(waiting)
                waiting = []
            waiting.append((rows[first:last], sketches[first:last]))
        yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["key", "a", "b"])
    if waiting:
        yield pd.DataFrame(np.array(told(waiting), np.int64).reshape(-1, 3), columns=["key", "a", "b"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each bucket that a set falls into."""
    for batch in batches:
        times = batch["own"].str.len().to_numpy(np.int64)
        yield pd.DataFrame({"key": np.frombuffer(b"".join(batch["keys"]), np.int64), "cls": np.repeat(batch["cls"].to_numpy(), times), "own": np.frombuffer(b"".join(batch["own"]), bool)})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"]):
            if last[0] != a:
                last = (a, shingle_set(ta))
            keep.append(linked(last[1], shingle_set(tb)))
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def _own_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of several texts of an id those whose set is the class's."""
    for batch in batches:
        keep = [digest(shingle_set(t)) == d for t, d in zip(batch["text"], batch["digest"])]
        yield batch.loc[np.array(keep, bool)]


def _few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A broadcast hint if the (checkpointed) rows are few enough, else none: then Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


class _Join:
    """What the steps share: the documents (id, text), the classes of equal sets (digest, head, cls) and their sketches."""

    def __init__(self, rows: DataFrame, classes: DataFrame, sets: DataFrame, members: DataFrame, several: bool):
        self.rows, self.classes, self.members, self.several = rows, classes, members, several
        self.sketches = sets.select("cls", "n", "sketch")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of classes that their sketches don't reject."""
        of = lambda x: self.sketches.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        return pairs.join(of("b"), "b").join(of("a"), "a").mapInPandas(_near, "a long, b long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose texts are linked; texts travel for candidates alone, one for each class."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(self.classes, "cls")
        texts = self.rows.join(_few(checkpointed(wanted)), self.rows["id"] == F.col("head")).select("cls", "digest", "text")
        if self.several:
            texts = texts.mapInPandas(_own_texts, texts.schema)
        texts = checkpointed(texts.groupBy("cls").agg(F.min("text").alias("text")))
        ta, tb = (texts.select(F.col("cls").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        return checkpointed(pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInPandas(_verified, "a long, b long"))

    def unmet(self, groups: DataFrame, brief: bool, keys: DataFrame | None = None) -> DataFrame:
        """Pairs (key, a, b) that may be linked in the buckets with members in several components; if ``brief``, enough to
        join them all."""
        parts = int(self.members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        labelled = self.members.join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls")).drop("component")
        spread = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("size").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("of")).filter("lo < hi")
        if keys is not None:
            spread = spread.join(keys, "key", "left_semi")
        spread = spread.groupBy("size", "of").agg(F.min("key").alias("key")).select("key")  # of buckets with the same members one
        many = labelled.join(spread, "key").join(self.sketches, "cls").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("own_tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
        # members of a bucket larger than a tile are dealt to tiles, and each pair of tiles is looked at by itself
        met = many.select("key", "cls", "n", "c", "sketch", "own_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        met = met.select("*", F.least("own_tile", "other").alias("x"), F.greatest("own_tile", "other").alias("y")).drop("other")
        return checkpointed(met.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(partial(_tiles, brief=brief), "key long, a long, b long"))

    def links(self) -> DataFrame:
        """(id, component) of the classes that are linked with others."""
        star = self.members.groupBy("cls").agg(F.min("first").alias("a")).filter("a <> cls").select("a", F.col("cls").alias("b"))
        links = self.verify(checkpointed(self.near(star)))
        groups = components(links)
        keys = None
        for brief in (True, False):
            rest = self.unmet(groups, brief, keys)
            pairs = checkpointed(rest.select("a", "b").distinct())
            if pairs.isEmpty():
                break
            found = self.verify(pairs)
            links = links.unionByName(found)
            groups = components(links)
            # pairs that a false one stood for are only in its bucket
            keys = checkpointed(rest.join(found, ["a", "b"], "left_anti").select("key").distinct())
            if keys.isEmpty():
                break
        return groups


def join_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", blocks: int | None = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles (its set's size) and component_id.

    Words are parted by ASCII white space, A-Z lower-cased; a set holds the distinct five-word shingles, or the
    whole sequence of fewer words. Two documents link if 100 * intersection >= 75 * union; component_id is the
    smallest id that links reach. Null, empty and blank texts have an empty set and link with nothing. Rows with
    the same id are one document of several texts and share a component; a null id links with nothing and has a
    null component. Other columns aren't returned. An empty table gives an empty one.

    Of sets above ``SMALL`` shingles ``blocks`` blocks are looked at: with the default a pair at the threshold shares none
    of them with a chance below 1e-12. With None all are, and no pair is lost whatever the hashes; keys grow with the texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = written(rows.mapInPandas(partial(_sketched, blocks=blocks), "id long, n long, digest binary, keys binary, own binary, sketch binary"))
    names = checkpointed(base.select("id", "n", "digest"))
    some = names.filter("n > 0 AND id IS NOT NULL")
    # equal sets are one class with a number of its own; its smallest id has its text
    classes = checkpointed(some.groupBy("digest").agg(F.min("id").alias("head")).withColumn("cls", F.monotonically_increasing_id()))
    twice = checkpointed(some.groupBy("id").agg((F.min("digest") != F.max("digest")).alias("several")).filter("several").select("id"))
    sets = written(base.join(classes.select(F.col("head").alias("id"), "digest", "cls"), ["id", "digest"]).dropDuplicates(["cls"]).select("cls", "n", "keys", "own", "sketch"))
    discard(base)
    entries = written(sets.select("cls", "keys", "own").mapInPandas(_entries, "key long, cls long, own boolean"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("first"), F.max(F.col("own").cast("int")).alias("any")).filter("size > 1 AND any = 1").drop("any")
    members = written(entries.select("key", "cls").join(buckets, "key"))
    discard(entries)
    groups = _Join(rows.filter("id IS NOT NULL"), classes, sets, members, not twice.isEmpty()).links()
    discard(sets, members)
    tops = classes.join(groups, classes["cls"] == groups["id"], "left").withColumn("top", F.coalesce("component", "cls")).select("digest", "head", "top")
    least = tops.groupBy("top").agg(F.min("head").alias("component"))
    own = some.join(tops.join(least, "top").select("digest", "component"), "digest")
    if not twice.isEmpty():  # an id with several texts joins what its texts are in
        joint = own.join(twice, "id").select(F.col("id").alias("a"), F.col("component").alias("b"))
        merged = components(joint).withColumnsRenamed({"id": "was", "component": "now"})
        own = own.join(merged, own["component"] == merged["was"], "left").withColumn("component", F.coalesce("now", "component"))
    out = own.select("id", "n", "component").unionByName(names.filter("n = 0 OR id IS NULL").select("id", "n", F.when(F.col("id").isNotNull(), F.col("id")).alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@apart
def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less all but the smallest id of each component, with their own columns.

    Of several rows with the same id one stays. Rows with a null id all stay.
    """
    found = checkpointed(join_similar(docs, id_col, text))
    gone = checkpointed(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct())
    left = docs.join(_few(gone), docs[id_col] == F.col("__gone"), "left_anti")
    again = checkpointed(found.groupBy(id_col).agg(F.count("*").alias("k")).filter(F.col("k") > 1).filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__again")))
    if again.isEmpty():
        return left
    first = left.join(_few(again), left[id_col] == F.col("__again"), "left_semi").dropDuplicates([id_col])
    return left.join(_few(again), left[id_col] == F.col("__again"), "left_anti").unionByName(first)
