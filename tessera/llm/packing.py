"""Packing of tokenized examples into training sequences: vector bin packing by the dot-product heuristic.

An example demands a vector: tokens, one segment, and loss-bearing tokens. An open sequence has the
vector that is left of its limits. The next example to enter is the one that fits and whose demand has the
largest dot product with what is left (Panigrahy et al., "Heuristics for vector bin packing", 2011): an example large
where there is room. If none fits whole, one is cut. Each task packs the rows that it reads, with a pool
of bounded size, so nothing is shuffled and any number of tasks run side by side.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded
from tessera.llm.token_count import PATTERN

#: Limits of a sequence: tokens, segments, loss-bearing tokens; and the examples that wait in a task's pool.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS, POOL = 2048, 64, 2048, 1024
_SEQUENCE_BITS = 36
SCHEMA = "{id} {type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level BPE, special strings included.

    The library itself needs several times the CPU time; the rank file beside it has the same vocabulary
    and merges, and the tests hold the ids of both against each other.
    """

    def __init__(self, ranks: bytes, special: dict[str, int]):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = special
        self.parts = regex.compile(f"({'|'.join(map(regex.escape, special))})") if special else None

    def __call__(self, text: str) -> np.ndarray:
        if self.parts is None or not any(s in text for s in self.special):
            return np.array(self.core.encode_ordinary(text), np.uint32)
        ids: list[int] = []
        for part in self.parts.split(text):
            ids += [self.special[part]] if part in self.special else self.core.encode_ordinary(part)
        return np.array(ids, np.uint32)


class Pool:
    """Pieces that wait to be placed, and the sequences they go to."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int):
        self.limits, self.sequence = np.array(limits, np.int64), first_sequence
        self.pieces: list[tuple] = []  # (document, start, ids, tokens of the document, where its loss begins)
        self.rows: list[tuple] = []

    @staticmethod
    def loss(piece: tuple) -> int:
        _, start, ids, _, loss_from = piece
        return max(0, start + len(ids) - max(start, loss_from))

    def add(self, doc, ids: np.ndarray, loss_from: int = 0) -> None:
        """Whole sequences of a long example leave at once; the rest waits."""
        full, n = int(self.limits[0]), len(ids)
        start = 0
        while n - start >= full and self.limits[2] >= full:
            self._emit([(doc, start, ids[start : start + full], n, loss_from)])
            start += full
        while start < n:  # where loss-bearing tokens are the tighter limit, pieces are shorter
            end = min(n, start + full)
            if (over := end - max(start, loss_from) - int(self.limits[2])) > 0:
                end -= over
            self.pieces.append((doc, start, ids[start:end], n, loss_from))
            start = end

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n, loss_from in pieces:
            piece = (doc, start, ids, n, loss_from)
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset, self.loss(piece)))
            offset += len(ids)
        self.sequence += 1

    def pack(self, until: int) -> None:
        """Fill sequences until no more than ``until`` pieces wait."""
        if len(self.pieces) <= until:
            return
        pieces = self.pieces
        demand = np.array([(len(p[2]), 1, self.loss(p)) for p in pieces], np.int64)
        weight = demand / self.limits
        waits, left_over = np.ones(len(pieces), bool), len(pieces)
        while left_over > until:
            room, chosen = self.limits.copy(), []
            while left_over and room[0] > 0 and room[1] > 0:
                fits = waits & (demand <= room).all(axis=1)
                if not fits.any():
                    break
                best = int(np.argmax(np.where(fits, weight @ (room / self.limits), -1.0)))
                chosen.append(pieces[best])
                room -= demand[best]
                waits[best], left_over = False, left_over - 1
            if left_over and room[0] > 0 and room[1] > 0:
                # nothing fits whole: the shortest that is left is cut, its rest waits on
                at = int(np.argmin(np.where(waits, demand[:, 0], 1 << 60)))
                doc, start, ids, n, loss_from = pieces[at]
                take = int(min(room[0], len(ids) - 1))
                take -= max(0, start + take - max(start, loss_from) - int(room[2]))
                if take > 0:
                    chosen.append((doc, start, ids[:take], n, loss_from))
                    pieces[at] = (doc, start + take, ids[take:], n, loss_from)
                    demand[at] = (len(ids) - take, 1, self.loss(pieces[at]))
                    weight[at] = demand[at] / self.limits
            self._close(chosen)
        self.pieces = [p for p, w in zip(pieces, waits, strict=True) if w]

    def _close(self, chosen: list[tuple]) -> None:
        """A sequence that isn't full is cut into lengths that need no padding: powers of two."""
        total, full = sum(len(p[2]) for p in chosen), int(self.limits[0])
        if total == full:
            self._emit(chosen)
            return
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            room, part = 1 << bit, []
            while room:
                doc, start, ids, n, loss_from = chosen.pop(0)
                take = min(room, len(ids))
                part.append((doc, start, ids[:take], n, loss_from))
                if take < len(ids):
                    chosen.insert(0, (doc, start + take, ids[take:], n, loss_from))
                room -= take
            self._emit(part)


_encoders: dict[tuple, Encoder] = {}  # one a Python worker


def _encoder(ranks: bytes, special: dict[str, int]) -> Encoder:
    key = (hash(ranks), *sorted(special.items()))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, special)
    return _encoders[key]


def pack(df: DataFrame, ranks: str, special: dict[str, int], end_id: int | None = 1, id_col: str = "doc_id", text: str = "text", prompt: str | None = None, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS), pool: int = POOL) -> DataFrame:
    """Pack the whole texts into sequences within ``limits`` (tokens, segments, loss-bearing tokens).

    Returns one row per piece: the id, start (tokens of the document before it), length, ids_crc32 (of the ids
    as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset within the sequence and n_loss. A
    document's ids are those of its prompt (column ``prompt``; they bear no loss), of its text, and ``end_id``.
    Null texts and prompts are empty: such a document is ``end_id`` alone. Sequences are full or of a power-of-two
    length; only in those cut from one task's last, unfilled sequences pieces are small. Repeated rows are packed
    each. A sequence_id holds the task's number, so that ids never clash. An empty table gives no rows.
    A repeated task must see its rows in the same order, as scans of files do.
    """
    if min(limits) < 1:
        raise ValueError("every limit is 1 or more")
    table = df.sparkSession.sparkContext.broadcast((bounded(ranks), special))
    kind = df.schema[id_col].dataType.simpleString()
    empty = F.lit("")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), empty).alias("text"), (F.coalesce(F.col(prompt), empty) if prompt else empty).alias("prompt"))
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, waiting = _encoder(*table.value), Pool(limits, TaskContext.get().partitionId() << _SEQUENCE_BITS)
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]

        def told() -> pd.DataFrame:
            out = pd.DataFrame(waiting.rows, columns=names)
            waiting.rows = []
            return out

        for batch in batches:
            for doc, body, head in zip(batch["id"], batch["text"], batch["prompt"], strict=True):
                before = encode(head) if head else tail[:0]
                waiting.add(doc, np.concatenate((before, encode(body), tail)), len(before))
                if len(waiting.pieces) >= 2 * pool:
                    waiting.pack(pool)
            if waiting.rows:
                yield told()
        waiting.pack(0)
        yield told()

    return rows.mapInPandas(packed, SCHEMA.format(id=f"`{id_col}`", type=kind))
