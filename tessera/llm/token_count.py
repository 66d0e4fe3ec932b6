"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte. A heap holds the adjacent pairs that the vocabulary can
merge; the pair of lowest rank (of equal ranks the leftmost) is popped again and again, and a linked
list joins the neighbours. The count is the initial symbols less the merges; no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, bounded

#: Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLACE_BITS = 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts. ``cache`` bounds the words whose counts are kept; when it is full it is emptied."""

    def __init__(self, model_json: bytes, cache: int = 400_000):
        model = json.loads(model_json)
        if model["model"]["type"] != "BPE" or (model["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        if model.get("normalizer") or model["pre_tokenizer"].get("add_prefix_space") or not model["pre_tokenizer"].get("use_regex", True):
            raise ValueError("a vocabulary that changes texts before words are parted isn't known here")
        symbols = byte_symbols()
        number: dict[str, int] = {s: i for i, s in enumerate(symbols)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((number[a], number[b]), (rank, number.setdefault(a + b, len(number))))
        special = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(PATTERN)
        self.cache, self.most = {}, cache

    def merges(self, word: bytes) -> int:
        """How many merges a word allows."""
        sym, n, merge = list(word), len(word), self.merge
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0] << _PLACE_BITS) | i for i in range(n - 1) if (m := merge.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & ((1 << _PLACE_BITS) - 1), top >> _PLACE_BITS
            j = after[i]
            if j < 0 or sym[i] < 0 or not (m := merge.get((sym[i], sym[j]))) or m[0] != rank:
                continue  # a neighbour was merged meanwhile
            sym[i], sym[j], after[i] = m[1], -1, after[j]
            done += 1
            if (k := after[j]) >= 0:
                before[k] = i
                if m := merge.get((sym[i], sym[k])):
                    heapq.heappush(heap, (m[0] << _PLACE_BITS) | i)
            if (h := before[i]) >= 0 and (m := merge.get((sym[h], sym[i]))):
                heapq.heappush(heap, (m[0] << _PLACE_BITS) | h)
        return done

    def plain(self, text: str) -> int:
        """The count of a text without special strings."""
        cache, total = self.cache, 0
        for word in self.words.findall(text):
            if (n := cache.get(word)) is None:
                raw = word.encode("utf-8")
                n = len(raw) - self.merges(raw)
                if len(word) <= 64:
                    if len(cache) >= self.most:
                        cache.clear()
                    cache[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """The count of a text; each special string inside it is one token."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[int, MergeCounter] = {}  # one a Python worker, so that tasks share the word cache


def _counter(model_json: bytes) -> MergeCounter:
    key = hash(model_json)
    if key not in _counters:
        _counters.clear()
        _counters[key] = MergeCounter(model_json)
    return _counters[key]


@apart
def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) for the whole text of each row.

    ``tokenizer`` is the path of a byte-level BPE .json file, read on the driver and broadcast (its size
    is checked). Null and empty texts: 0 bytes, 0 tokens, false. Repeated rows are counted each. Extra
    columns are kept; columns with the names of the results are replaced. An empty table gives an empty one.
    """
    model = df.sparkSession.sparkContext.broadcast(bounded(tokenizer))

    @F.pandas_udf("n_bytes long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(model.value)
        for texts in batches:
            texts = texts.fillna("")
            yield pd.DataFrame({"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": [counter.count(t) for t in texts]}, dtype="int64")

    made = "__counted"
    out = df.drop("n_bytes", "n_tokens", "over_limit").withColumn(made, counted(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({"n_bytes": F.col(made)["n_bytes"], "n_tokens": F.col(made)["n_tokens"], "over_limit": F.col(made)["n_tokens"] > limit}).drop(made)
