"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact verification.

Every benchmark item gets a 64-bit SimHash of its weighted word shingles. Windows of an item's length slide
over each document; a window's SimHash is looked up, among the items of its length, in a multi-index (Norouzi, Punjani and
Fleet, "Fast search in Hamming space with multi-index hashing", 2012): four blocks of 16 bits, of which one at least differs
in no more than RADIUS // 4 bits if the whole differs in no more than RADIUS. A block keeps each of its values once, with its
items; the near values are those that are, or of many values those that the masks of so few bits lead to. Candidates are verified by exact weighted Jaccard
similarity of shingle multisets. Windows that hold no shingle of any item have similarity 0 with all of them and
aren't hashed; that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, run_hashes, shingle_hashes, unlike, word_hashes, written

#: Words of a shingle, the similarity that counts as a leak, and the Hamming radius of the candidate search.
SHINGLE, SIMILARITY, RADIUS = 5, 0.75, 22
BLOCKS, BLOCK_BITS = 4, 16
#: Benchmarks of more characters than this are searched block by block, each broadcast by itself.
BLOCK_CHARS = 4 << 20
LEAKS = "array<struct<item_id:bigint,start_word:bigint,similarity:double>>"
_BITS = np.arange(64, dtype=np.uint64)
#: For each number of bits, the masks that flip no more of a block.
_MASKS = [np.array([sum(1 << b for b in c) for r in range(near + 1) for c in combinations(range(BLOCK_BITS), r)], np.uint16) for near in range(RADIUS // BLOCKS + 1)]


def spread(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1


def folded(sums: np.ndarray) -> np.ndarray:
    """SimHash: the bits whose weighted sums are positive."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Blocks:
    """The multi-index over fingerprints."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.near, self.tables = prints, radius, radius // BLOCKS, []
        for b in range(BLOCKS):
            block = (prints >> np.uint64(BLOCK_BITS * b)).astype(np.uint16)
            order = np.argsort(block, kind="stable")
            values, first = np.unique(block[order], return_index=True)
            self.tables.append((values, np.append(first, len(block)), order.astype(np.int32)))

    def candidates(self, fingerprint: np.uint64) -> np.ndarray:
        """The places of fingerprints with a block near the same block of this one."""
        found = []
        for b, (values, edge, order) in enumerate(self.tables):
            v = np.uint16((int(fingerprint) >> (BLOCK_BITS * b)) & 0xFFFF)
            if len(values) <= len(_MASKS[self.near]):
                near = np.flatnonzero(np.bitwise_count(values ^ v) <= self.near)
            else:
                wanted = _MASKS[self.near] ^ v
                near = np.searchsorted(values, wanted).clip(max=len(values) - 1)
                near = near[values[near] == wanted]
            found += [order[edge[i] : edge[i + 1]] for i in near]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)

    def lookup(self, fingerprint: np.uint64) -> np.ndarray:
        """The places of all fingerprints within the radius."""
        near = self.candidates(fingerprint)
        return near[np.bitwise_count(self.prints[near] ^ fingerprint) <= self.radius]


def _ranges(values: np.ndarray, size: int) -> np.ndarray:
    """Where each number below ``size`` begins among sorted values, and the end."""
    return np.searchsorted(values, np.arange(size + 1)).astype(np.int32)


class Index:
    """Benchmark items: their shingles and weights in flat arrays, and fingerprints in a multi-index for each length."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.radius = radius
        words = [word_hashes(text.encode("utf-8")) for _, text in items]
        keep = [k for k, w in enumerate(words) if len(w)]
        self.ids = [items[k][0] for k in keep]
        shingles = [shingle_hashes(words[k], SHINGLE) for k in keep]
        self.length = np.array([len(words[k]) for k in keep], np.int32)
        self.known, df = np.unique(np.concatenate([np.unique(s) for s in shingles] or [np.zeros(0, np.uint64)]), return_counts=True)
        # rarer shingles of the benchmark weigh more; one that a single item holds weighs 1
        self.weight = (np.log1p(len(keep) / df) / np.log1p(max(1, len(keep)))).astype(np.float64)
        bags, prints = [np.zeros((3, 0), np.int32)], np.zeros(len(keep), np.uint64)
        for k, s in enumerate(shingles):
            at = np.searchsorted(self.known, s)
            place, n = np.unique(at, return_counts=True)
            bags.append(np.stack((np.full(len(place), k), place, n)).astype(np.int32))
            prints[k] = folded((spread(s) * self.weight[at][:, None]).sum(0, keepdims=True))[0]
        item, self.place, self.times = np.concatenate(bags, axis=1)
        self.bag = _ranges(item, len(keep))
        order = np.argsort(self.place, kind="stable")  # of each shingle the lengths of the items that hold it
        pairs = np.unique(np.stack((self.place[order], self.length[item[order]])), axis=1) if len(item) else np.zeros((2, 0), np.int32)
        self.held, self.holder_length = _ranges(pairs[0], len(self.known)), pairs[1]
        self.prints = prints
        self.short = sorted({int(n) for n in self.length if n < SHINGLE})
        self.of_length = {int(n): np.flatnonzero(self.length == n).astype(np.int32) for n in np.unique(self.length)}
        self.blocks = {n: Blocks(prints[own], radius) for n, own in self.of_length.items()}

    def lookup(self, fingerprint: np.uint64, length: int) -> np.ndarray:
        """All items of a length whose fingerprint is within the radius."""
        return self.of_length[length][self.blocks[length].lookup(fingerprint)]

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Weighted Jaccard similarity of shingle multisets; shingles that no item has weigh 1."""
        own = slice(self.bag[item], self.bag[item + 1])
        place, n = self.place[own], self.times[own]
        values, counts = np.unique(shingles, return_counts=True)
        at = np.searchsorted(self.known, values).clip(max=len(self.known) - 1)
        own = self.known[at] == values
        weight = np.where(own, self.weight[at], 1.0)
        have = dict(zip(at[own].tolist(), counts[own].tolist()))
        common = sum(min(have.get(p, 0), c) * self.weight[p] for p, c in zip(place.tolist(), n.tolist()))
        total = float(weight @ counts) + float(self.weight[place] @ n) - common
        return common / total if total else 0.0

    def search(self, text: bytes, least: float = SIMILARITY) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of each leaked item, at its best window; the first of equally good ones."""
        words = word_hashes(text)
        if not len(words) or not len(self.known):
            return []
        best: dict[int | None, tuple[float, int]] = {}
        for size in {*self.short, SHINGLE}:
            if len(words) < size:
                continue
            s = run_hashes(words, size)
            at = np.searchsorted(self.known, s).clip(max=len(self.known) - 1)
            hit = self.known[at] == s
            if hit.any():
                self._windows(s, at, hit, size, least, best)
        return [(item, *best[item][::-1]) for item in sorted(best, key=lambda i: (i is not None, i or 0))]

    def _windows(self, s: np.ndarray, at: np.ndarray, hit: np.ndarray, size: int, least: float, best: dict) -> None:
        places = np.flatnonzero(hit)
        by_length: dict[int, list[np.ndarray]] = {}
        known = at[places]
        for p in np.unique(known):  # windows of the lengths of the items that hold a shingle found here
            here = places[known == p]
            for length in self.holder_length[self.held[p] : self.held[p + 1]].tolist():
                if (length >= SHINGLE) == (size == SHINGLE):
                    by_length.setdefault(length, []).append(here)
        weight = np.where(hit, self.weight[at], 1.0)
        for length, found in by_length.items():
            n = length - size + 1  # shingles of a window
            if length < SHINGLE:
                n = 1
            around = np.unique(np.concatenate(found))
            starts = np.unique(np.clip(around[:, None] - np.arange(n), 0, max(0, len(s) - n)).ravel())
            if len(s) < n:
                starts = np.zeros(1, np.int64)
            for part in np.array_split(starts, len(starts) // 4096 + 1):
                low, high = int(part[0]), min(len(s), int(part[-1]) + n)
                if high - low <= 16 * len(part) + n:
                    sums = np.zeros((high - low + 1, 64))
                    np.cumsum(spread(s[low:high]) * weight[low:high, None], axis=0, out=sums[1:])
                    prints = folded(sums[np.minimum(part + n, high) - low] - sums[part - low] - 1e-9)
                else:
                    prints = np.array([folded((spread(s[a : a + n]) * weight[a : a + n, None]).sum(0, keepdims=True) - 1e-9)[0] for a in part])
                for start, fingerprint in zip(part.tolist(), prints):
                    for k in self.lookup(fingerprint, length).tolist():
                        score, item = round(float(self.similarity(k, s[start : start + n])), 9), self.ids[k]  # sums of other order tie
                        if score >= least and (item not in best or (score, -start) > (best[item][0], -best[item][1])):
                            best[item] = (score, start)


def _searching(index, least: float):
    """The search as a column function."""

    @F.pandas_udf(LEAKS)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            found = (index.value.search(t.encode("utf-8"), least) for t in series)
            yield pd.Series([[{"item_id": i, "start_word": w, "similarity": s} for i, w, s in f] for f in found], dtype="object")

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY, radius: int = RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add leaked_items (array of structs item_id, start_word, similarity; in order of the item) to each row.

    Words are parted by ASCII white space, A-Z lower-cased. An item of fewer than five words is one shingle.
    Null or empty texts and items leak nothing. Every whole text is searched. A benchmark larger than
    ``block_chars`` is split by the hash of its ids into blocks, and the documents pass through each block in turn: what one
    block finds is written before the next block's index is built, so that one index at a time is in memory. Items without
    an id are searched for too, as one item of several texts whose id is null.
    Repeated rows are judged each. An item of several texts is told once, at the best window of any. Extra columns are
    kept, and a column leaked_items is replaced. ``radius`` is at most RADIUS.
    """
    if radius > RADIUS:
        raise ValueError(f"the radius is at most {RADIUS}")
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("body")).distinct()
    chars = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    out = docs.drop("leaked_items").withColumn("leaked_items", F.array().cast(LEAKS))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "body").collect()  # block_chars characters on average
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["body"]) for r in own], radius))
        found = out.withColumn("leaked_items", F.concat("leaked_items", _searching(index, least)(F.coalesce(F.col(text), F.lit("")))))
        if blocks == 1:
            return found
        found = written(found)
        index.destroy()
        if block:
            discard(out)
        out = found
    return out.withColumn("leaked_items", F.array_sort("leaked_items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns; one named leaked_items is set aside meanwhile."""
    aside = unlike("leaked_items_", *docs.columns)
    own = docs.withColumnRenamed("leaked_items", aside)
    return find_leaks(own, benchmark).filter(F.size("leaked_items") == 0).select(*own.columns).withColumnRenamed(aside, "leaked_items")
