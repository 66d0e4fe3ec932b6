"""Removal of repeated passages: each byte covered by a 100-byte string that also starts earlier.

 1. Every 100-byte window has an anchor, the 32-byte string in it of least hash (winnowing: Schleimer, Wilkerson and
    Aiken, 2003), so equal windows have equal anchors in the same place. Windows next to each other with the same anchor
    are one context. Equal contexts, known by 64-bit hashes of anchor and context both, are resolved at once: all
    but the earliest are covered. Each task does so with its own rows first, so hot passages shrink before the shuffle.
 2. Anchors that remain in one context alone repeat nothing. The others' contexts are fetched, and a suffix
    array (see suffix_array) of each group of contexts around an anchor shows the windows that they share.
 3. An anchor with more contexts than a group holds is split by content: windows that begin further before the anchor than
    half of what is possible all hold the same stretch before it, the others the same stretch after it, so each half is
    grouped by its stretch. Contexts cut to a half that are equal as a whole are resolved there, all but the earliest; halves
    that are still too many are split again, until a group is a single window. Equal windows never part.
 4. What is covered is merged for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import apart, checkpointed, discard, mixed, prefix_sums, written
from tessera.llm.suffix_array import suffix_array

LENGTH, ANCHOR = 100, 32
#: Contexts of a group, bytes that are suffix-sorted at once, documents of which one is looked at for hot anchors,
#: the contexts in that sample that make an anchor hot, and characters that a task works on at once.
TILE, SORTED, ONE_IN, HOT, PIECE = 256, 32_768, 64, 32, 4 << 20
#: Hot anchors that are told to the tasks at most; contexts (of 24 bytes each), or numbers, that are broadcast at most.
MOST_HOT, MOST_BROADCAST = 100_000, 2_000_000
#: How far before its anchor a window may begin.
WIDEST = LENGTH - ANCHOR
_PLACE = np.uint64((1 << 24) - 1)
_WHERE = np.uint64(0x9E3779B97F4A7C15)
FLAT = "kind int, anchor long, hot int, doc long, start long, stop long, at long"
BODIES = "key long, low int, high int, doc long, start long, ahead int, body binary"


def contexts(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Rows (hash of the anchor, hash of the context, place of the anchor, first window, last window) of a text."""
    data, span = np.frombuffer(text, np.uint8), length - anchor + 1
    parts = [np.zeros((5, 0), np.uint64)]
    step = 1 << 23  # windows of a piece: the place of an anchor in it has 24 bits
    for begin in range(0, max(0, len(data) - length + 1), step):
        piece = data[begin : begin + step + length - 1]
        sums, down = prefix_sums(piece)
        m = len(piece) - anchor + 1
        h = mixed((sums[anchor:] - sums[:m]) * down[:m])
        least = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        at = at[first]
        whole = mixed((sums[last + length] - sums[first]) * down[first] + (at - first).astype(np.uint64) * _WHERE + (last - first).astype(np.uint64))
        parts.append(np.stack((h[at], whole, *((x + begin).astype(np.uint64) for x in (at, first, last)))))
    return np.concatenate(parts, axis=1)


def _gathered(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents and contexts of a batch, in order of (anchor, context, document, place)."""
    found = [contexts(t.encode("utf-8")) for t in batch["text"]]
    rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.uint64)
    doc = np.repeat(batch["id"].to_numpy(np.int64), [f.shape[1] for f in found])
    order = np.lexsort((rows[2], doc, rows[1], rows[0]))
    return doc[order], rows[:, order]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in pieces of about PIECE characters of text, which bounds what a task holds of them."""
    for batch in batches:
        at = batch["text"].str.len().cumsum().to_numpy() // PIECE
        for first, last in zip(*(lambda e: (e, [*e[1:], len(batch)]))(np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist() if len(batch) else [])):
            yield batch.iloc[first:last]


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Whether each row begins a new (anchor, context)."""
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return new


def _hot(docs: DataFrame) -> np.ndarray:
    """Anchors with very many contexts, from a sample of the documents, in order. Only the dealing depends on it."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            _, rows = _gathered(batch)
            rows = rows[:, _firsts(rows)]
            yield pd.DataFrame({"anchor": rows[0].view(np.int64), "context": rows[1].view(np.int64)})

    some = docs.filter(F.pmod(F.xxhash64("id"), F.lit(ONE_IN)) == 0).mapInPandas(pairs, "anchor long, context long")
    many = some.distinct().groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT)
    found = [r["anchor"] for r in many.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _dealt(docs: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """The contexts of all documents, the earliest of equal ones in each batch, packed by the part they go to."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            doc, rows = _gathered(batch)
            new = _firsts(rows)
            out = []
            if not new.all():  # an equal context earlier in this batch: covered
                d, s, e = doc[~new], rows[3][~new].astype(np.int64), rows[4][~new].astype(np.int64) + LENGTH
                out.append((int(d[0]) % parts, 1, b"", b"", d.tobytes(), s.tobytes(), e.tobytes()))
            doc, rows = doc[new], rows[:, new]
            known = shared.value
            is_hot = np.isin(rows[0], known) if len(known) else np.zeros(len(doc), bool)
            part = (np.where(is_hot, mixed(rows[0] ^ (rows[1] * _WHERE)), rows[0]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            where = (rows[2] << np.uint64(16)) | ((rows[2] - rows[3]) << np.uint64(8)) | (rows[2] - rows[4])
            for p in np.flatnonzero(np.diff(edge)):
                own = order[edge[p] : edge[p + 1]]
                out.append((int(p), 0, rows[0][own].tobytes(), rows[1][own].tobytes(), doc[own].tobytes(), where[own].tobytes(), b""))
            yield pd.DataFrame(out, columns=["part", "kind", "anchor", "context", "doc", "a", "b"])

    return docs.mapInPandas(dealt, "part int, kind int, anchor binary, context binary, doc binary, a binary, b binary")


def _flat(kind: int, doc, start, stop, anchor=None, hot=None, at=None) -> pd.DataFrame:
    none = np.zeros(len(doc), np.int64)
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int32), "anchor": none if anchor is None else anchor, "hot": none.astype(np.int32) if hot is None else hot, "doc": doc, "start": start, "stop": stop, "at": none if at is None else at})


def _matched(packed: DataFrame, hot: np.ndarray) -> DataFrame:
    """kind 1: what is covered; kind 0: contexts of anchors with several, hot if they may be too many for a group."""
    shared = packed.sparkSession.sparkContext.broadcast(hot)

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = lambda own, c, kind: np.frombuffer(b"".join(own[c]), kind)
        over, rest = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 0]
        out = [_flat(1, joined(over, "doc", np.int64), joined(over, "a", np.int64), joined(over, "b", np.int64))]
        anchor, context, doc, where = (joined(rest, c, k) for c, k in (("anchor", np.uint64), ("context", np.uint64), ("doc", np.int64), ("a", np.uint64)))
        order = np.lexsort((where, doc, context, anchor))
        anchor, context, doc, where = anchor[order], context[order], doc[order], where[order]
        at = (where >> np.uint64(16)).astype(np.int64)
        start = at - ((where >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        stop = at - (where & np.uint64(255)).astype(np.int64) + LENGTH
        new = _firsts(np.stack((anchor, context)))
        out.append(_flat(1, doc[~new], start[~new], stop[~new]))
        anchor, doc, at, start, stop = (x[new] for x in (anchor, doc, at, start, stop))
        head = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
        number = np.cumsum(head) - 1
        count = (np.bincount(number) if len(number) else number)[number]
        dealt = np.isin(anchor, shared.value) if len(shared.value) else np.zeros(len(anchor), bool)
        keep = (count > 1) | dealt  # contexts of a dealt anchor are in other parts too
        out.append(_flat(0, doc[keep], start[keep], stop[keep], anchor[keep].view(np.int64), (dealt | (count > TILE))[keep].astype(np.int32), at[keep]))
        return pd.concat(out)

    return packed.groupBy("part").applyInPandas(matched, FLAT)


def _fetched(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of the contexts that are to be sorted, keyed by their anchors; low 0 and high -1 unless hot."""
    # three numbers a context: the anchor, whether it is hot, and start * 2**16 + length * 2**8 + place of the anchor
    where = F.col("start") * 65536 + (F.col("stop") - F.col("start")) * 256 + (F.col("at") - F.col("start"))
    piece = F.floor(F.col("start") / PIECE)  # a very long text has its contexts in several rows
    own = found.filter("kind = 0").groupBy("doc", piece).agg(F.flatten(F.collect_list(F.array("anchor", F.col("hot").cast("long"), where))).alias("places")).select("doc", "places")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _pieces(iter([batch])):
                places = [np.asarray(p, np.int64).reshape(-1, 3) for p in rows["places"]]
                all_of = np.concatenate(places)
                start, size = all_of[:, 2] >> 16, (all_of[:, 2] >> 8) & 255
                raw = [t.encode("utf-8") for t in rows["text"]]
                of = np.repeat(np.arange(len(raw)), [len(p) for p in places])
                bodies = [raw[i][a : a + n] for i, a, n in zip(of.tolist(), start.tolist(), size.tolist())]
                yield pd.DataFrame({"key": all_of[:, 0], "low": np.zeros(len(of), np.int32), "high": np.where(all_of[:, 1] > 0, WIDEST, -1).astype(np.int32), "doc": rows["doc"].to_numpy()[of], "start": start, "ahead": (all_of[:, 2] & 255).astype(np.int32), "body": bodies})

    side = own if found.filter("kind = 0").count() > MOST_BROADCAST else F.broadcast(own)
    return docs.join(side, docs["id"] == side["doc"]).select("doc", "text", "places").mapInPandas(cut, BODIES)


def _halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each context's windows by how far they begin before the anchor: those of [low, middle] and those beyond. A half's key
    is of the bytes that all its windows hold."""
    for batch in batches:
        out = []
        for key, low, high, doc, start, ahead, body in batch[["key", "low", "high", "doc", "start", "ahead", "body"]].itertuples(index=False):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                least, most = max(a, ahead + LENGTH - len(body)), min(b, ahead)
                if least <= most:
                    core = body[ahead - a : ahead - b + LENGTH]
                    name = hashlib.blake2b(b"%d,%d,%d," % (key, a, b) + core, digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), a, b, doc, start + ahead - most, most, body[ahead - most : ahead - least + LENGTH]))
        yield pd.DataFrame(out, columns=["key", "low", "high", "doc", "start", "ahead", "body"])


def _split(hot: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups of bounded size (as BODIES) and spans (doc, start, stop), from contexts that may be too many for a group."""
    groups, spans = [], []
    while not hot.isEmpty():
        rows = checkpointed(hot.mapInPandas(_halved, BODIES))
        same = ["key", "ahead", "body"]
        first = rows.groupBy(*same).agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
        first = checkpointed(first)
        late = rows.join(first.filter("n > 1").select(*same, "least"), same).filter(F.struct("doc", "start") != F.col("least"))
        spans.append(late.select("doc", "start", (F.col("start") + F.length("body")).alias("stop")))
        sizes = first.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        left = checkpointed(first.join(sizes, "key").select("key", "low", "high", "least.doc", "least.start", "ahead", "body", (F.col("size") > TILE).alias("many")))
        groups.append(left.filter("NOT many OR low = high").drop("many"))
        hot = left.filter("many AND low < high").drop("many")
    return groups, spans


def _promising(rows: pd.DataFrame) -> np.ndarray:
    """Contexts that share the anchor with 34 more bytes before or after it: every window has one or the other."""
    before, after = (LENGTH - ANCHOR) // 2, ANCHOR + (LENGTH - ANCHOR) // 2
    seen: dict[tuple, int] = {}
    keys = []
    for anchor, ahead, body in zip(rows["key"], rows["ahead"], rows["body"]):
        pair = []
        if ahead >= before:
            pair.append((anchor, 0, body[ahead - before : ahead + ANCHOR]))
        if len(body) >= ahead + after:
            pair.append((anchor, 1, body[ahead : ahead + after]))
        for k in pair:
            seen[k] = seen.get(k, 0) + 1
        keys.append(pair)
    return np.array([any(seen[k] > 1 for k in pair) for pair in keys], bool)


def _shared_windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the bodies in order of a suffix array: (body, place in it, number of the window's string)."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies])
    of = np.repeat(np.arange(len(bodies)), size)
    begin = np.cumsum(size) - size
    text = np.zeros(len(data) + len(bodies) + 1, np.int64)  # a separator of value 1 after each body, then the end, 0
    text[np.arange(len(data)) + of] = data.astype(np.int64) + 2
    text[np.cumsum(size + 1) - 1] = 1
    place = np.full(len(text), -1, np.int64)
    place[np.arange(len(data)) + of] = np.arange(len(data))
    order = place[np.array(suffix_array(text), np.int64)]
    order = order[order >= 0]
    body = of[order]
    inside = order - begin[body]
    whole = inside + LENGTH <= size[body]
    order, body, inside = order[whole], body[whole], inside[whole]
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[order]
    differs = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)] if len(order) else np.zeros(0, bool)
    return body, inside, np.cumsum(differs) - 1


def _spans(doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Covered windows of documents as stretches."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1 if len(doc) else first
    return _flat(1, doc[first], start[first], start[last] + LENGTH)


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is covered in the groups of a part."""
    pdf = pdf.sort_values(["key", "doc", "start"], kind="stable")
    pdf = pdf[_promising(pdf)]
    out, first = [_spans(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    key = pdf["key"].to_numpy()
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = np.r_[head[1:], len(pdf)]
    sizes = np.cumsum(np.r_[0, pdf["body"].str.len().to_numpy(np.int64)])
    for g in range(len(head)):  # groups are sorted together while they are small; their anchors keep their windows apart
        if g + 1 < len(head) and sizes[ends[g + 1]] - sizes[head[first]] <= SORTED:
            continue
        rows = pdf.iloc[head[first] : ends[g]]
        first = g + 1
        body, inside, number = _shared_windows(list(rows["body"]))
        doc, start = rows["doc"].to_numpy()[body], rows["start"].to_numpy()[body] + inside
        order = np.lexsort((start, doc, number))
        number, doc, start = number[order], doc[order], start[order]
        # a place may be in several contexts of a hot anchor's halves: only another place is a repeat
        new = np.r_[True, number[1:] != number[:-1]]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
        late = (doc != doc[lead]) | (start != start[lead])
        out.append(_spans(doc[late], start[late]))
    return pd.concat(out)[["doc", "start", "stop"]]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _merged(spans: pd.Series) -> pd.Series:
    """Stretches (start, stop, start, stop, ...) that overlap or touch, made one."""
    out = []
    for own in spans:
        x = np.array([(s["start"], s["stop"]) for s in own], np.int64)
        x = x[np.argsort(x[:, 0], kind="stable")]
        far = np.maximum.accumulate(x[:, 1])
        first = np.flatnonzero(np.r_[True, x[1:, 0] > far[:-1]])
        out.append(np.stack((x[first, 0], far[np.r_[first[1:], len(x)] - 1]), 1).ravel())
    return pd.Series(out)


def covered(docs: DataFrame) -> DataFrame:
    """(doc, spans) of the documents (id, text; ids unique and not null) with a covered byte; spans is flat."""
    spark = docs.sparkSession
    # a part holds about as much as a split of the input, so that it stays the same when the input grows
    parts = 2 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    hot = _hot(docs)
    found = written(_matched(_dealt(docs, hot, parts), hot))
    bodies = written(_fetched(found, docs))
    groups, spans = _split(bodies.filter("high >= 0"))
    ready = reduce(DataFrame.unionByName, [bodies.filter("high < 0"), *groups])
    tasks = max(parts, ready.count() // 4096)
    ordered = ready.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(tasks))).groupBy("part").applyInPandas(_sorted, "doc long, start long, stop long")
    spans = reduce(DataFrame.unionByName, [found.filter("kind = 1").select("doc", "start", "stop"), ordered, *spans])
    out = checkpointed(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumn("spans", _merged("spans")))
    discard(found, bodies)
    return out


def with_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add __spans, the covered stretches of each row's UTF-8 bytes (null if none).

    Where ids repeat or are null, each distinct (id, text) is a document of its own, in order of id (null first)
    and of the text's hash; otherwise the ids themselves give the order.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL").isEmpty()
    if plain:
        spans = covered(rows)
        few = F.broadcast(spans) if spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first()["n"] + spans.count() <= MOST_BROADCAST else spans
        few = few.withColumnsRenamed({"doc": "__doc", "spans": "__spans"})
        return df.join(few, F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    once = rows.distinct().withColumn("name", F.sha2("text", 256)).orderBy(F.asc_nulls_first("id"), "name").withColumn("number", F.monotonically_increasing_id())
    once = written(once)
    spans = covered(once.select(F.col("number").alias("id"), "text"))
    named = once.join(spans, once["number"] == spans["doc"]).select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("spans").alias("__spans"))
    body = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return df.join(named, F.col(id_col).eqNullSafe(F.col("__id")) & (body == F.col("__name")), "left").drop("__id", "__name")


TOLD = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])


def _kept(raw: bytes, spans) -> bytes:
    if spans is None:
        return raw
    edges = [0, *map(int, spans), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


@F.pandas_udf(TOLD)
def _told(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, spans):
        raw = text.encode("utf-8")
        kept = _kept(raw, own)
        rows.append((len(raw), len(raw) - len(kept), 0 if own is None else len(own) // 2, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([_kept(t.encode("utf-8"), s).decode("utf-8", "ignore") for t, s in zip(texts, spans)], dtype="object")


#: Said not to be deterministic, so that a filter on what it gives doesn't have it worked out twice.
_cleaned = _cut.asNondeterministic()


@apart
def digest(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller id, or before it in the same document.
    Null texts are empty; texts under 100 bytes lose nothing; matches never cross documents, and are judged on
    the texts as given. Other columns aren't returned; an empty table gives an empty one.
    """
    out = with_spans(df, id_col, text).select(F.col(id_col), _told(F.coalesce(F.col(text), F.lit("")), F.col("__spans")).alias("t"))
    return out.select(id_col, "t.*")


@apart
def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less their repeated passages, with their own columns; n_chars, if there, is counted anew.

    Bytes left of a character that was cut are dropped. Documents of which nothing is left go.
    """
    found = with_spans(docs, id_col, text)
    touched = F.col("__spans").isNotNull()
    out = found.withColumn(text, F.when(touched, _cleaned(F.coalesce(F.col(text), F.lit("")), F.col("__spans"))).otherwise(F.col(text)))
    out = out.filter(~touched | (F.length(text) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
