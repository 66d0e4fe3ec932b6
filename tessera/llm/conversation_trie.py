"""Prefix trie of conversations whose beginnings are taken from other conversations.

A conversation is rebuilt from the first turns of its base and its own later turns; its prefixes are the trie's nodes.
No rebuilt text is made. A turn is an element of a monoid, an affine map x -> a x + b modulo the prime 2**127 - 1 that its
digest gives; a sequence of turns is the product of theirs. The product of a base's head and the product of a conversation's
own suffix are found side by side and combined afterwards, so a head that a hundred conversations begin with is multiplied
once. The image of 0 and the depth name a node.

Turns are range-partitioned by (conversation, turn), so a conversation of any length spreads over tasks; products of the few
stretches that meet at task borders are chained. Equality doesn't rest on hashes: a turn refers to its text by a class, each
class is shown to have one text, and each node to have one parent and one class of last turns. By induction over the depth
all members of a node then begin alike. Where that fails, all is done anew with other digests.

Each node belongs to the chain of its smallest member, which runs down that conversation's path; chains hang on each other
as a forest that is as high as branches are nested. Sums over subtrees are sums over chains below by pointer doubling, then
running sums up each chain in blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, discard, written

#: Conversations to a base, and one more than the turns of a head at most.
FAMILY, HEADS = 100, 6
#: A prime modulus; turns of a chunk that travels to its base's head; ids of a node that are joined in one text; depths of a block.
PRIME, CHUNK, TOLD, BLOCK = (1 << 127) - 1, 512, 1 << 16, 1024
#: Code points of role and text by which turns of equal number are dealt to tasks; within a task whole texts are compared.
DEALT = 64
Element = tuple[int, int]
ONE: Element = (1, 0)


def then(first: Element, second: Element) -> Element:
    """The product of two sequences: the map of the first, followed by that of the second."""
    return first[0] * second[0] % PRIME, (second[0] * first[1] + second[1]) % PRIME


def element(digest: bytes) -> Element:
    """A turn's map; its factor isn't 0."""
    return 1 + int.from_bytes(digest[:16], "big") % (PRIME - 1), int.from_bytes(digest[16:], "big") % PRIME


def head_turns(conv: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % HEADS


class Stretch:
    """The turns of one conversation that stand together in a task, as products after each possible head."""

    def __init__(self, conv: int):
        self.conv, self.n, self.first, self.rest = conv, 0, [], ONE

    def add(self, turn: Element) -> None:
        self.n += 1
        if self.n < HEADS:
            self.first.append(turn)
        else:
            self.rest = then(self.rest, turn)

    def after(self, k: int) -> Element:
        """The product of all turns but the first ``k``."""
        out = ONE
        for turn in self.first[k:]:
            out = then(out, turn)
        return then(out, self.rest)


def _pairs(values: list[int]) -> np.ndarray:
    """127-bit numbers as two columns of longs."""
    return np.frombuffer(b"".join(v.to_bytes(16, "big") for v in values), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)


def _known(blob: bytes) -> list[Element]:
    return [(int.from_bytes(blob[i : i + 16], "big"), int.from_bytes(blob[i + 16 : i + 32], "big")) for i in range(0, len(blob), 32)]


def _blob(parts: list[Element]) -> bytes:
    return b"".join(a.to_bytes(16, "big") + b.to_bytes(16, "big") for a, b in parts)


def _spelled(role: str, text: str) -> Column:
    """A turn as one string, from which role and text can be told."""
    return F.concat(F.char_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text))


def ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str, salt: str, bits: int) -> DataFrame:
    """Rows (c, k1, k2, digest, chars, p) of all turns in order; p is the partition, k1 and k2 the turn's class."""
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(name) for k, name in ((role, "role"), (text, "text"))]
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), *told)
    rows = rows.repartitionByRange(n, "c", "t", F.substring("role", 1, DEALT), F.substring("text", 1, DEALT)).sortWithinPartitions("c", "t", "role", "text")
    digest = F.substring(F.sha2(F.concat(F.lit(salt), _spelled("role", "text")).cast("binary"), 256), 1, bits // 4)
    digest = F.unhex(F.rpad(digest, 64, "0"))  # fewer bits than 256 only where tests want classes and prefixes to collide
    part = lambda k: F.conv(F.hex(F.substring("digest", k, 8)), 16, -10).cast("long")
    made = rows.select("c", digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))
    return checkpointed(made.select("c", part(1).alias("k1"), part(9).alias("k2"), "digest", "chars", F.spark_partition_id().alias("p")))


def classes_hold(conversations: DataFrame, role: str, text: str, salt: str, bits: int) -> bool:
    """Whether each class of turns has one role and text only."""
    told = conversations.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(name) for k, name in ((role, "role"), (text, "text"))))
    named = told.select(_spelled("role", "text").alias("turn")).select("turn", F.rpad(F.substring(F.sha2(F.concat(F.lit(salt), F.col("turn")).cast("binary"), 256), 1, bits // 4), 64, "0").alias("digest"))
    groups = named.groupBy(F.substring("digest", 1, 32).alias("k")).agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    return groups.filter("low <> high").isEmpty()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(p, c, k1, k2, digest, chars) of each row of a task."""
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in ("p", "c", "k1", "k2", "digest", "chars")))


#: What a task must know: the conversation of its first row, the turns before that row, their product after the head,
#: their product from the first turn on, and whether the conversation of its last row goes on in another task.
Border = tuple[int, int, Element, Element, bool]


def borders(rows: DataFrame) -> dict[int, Border]:
    """What each task that has rows must know of those before and after it."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Stretch] = []  # the task's first stretch, and its last one if that is another
        p = None
        for p, c, _, _, digest, _ in _turns(batches):
            if not found or c != found[-1].conv:
                found[1:] = [Stretch(c)] if found else []
                found = found or [Stretch(c)]
            found[-1].add(element(digest))
        data = {"p": [p] * len(found), "place": list(range(len(found))), "c": [s.conv for s in found], "n": [s.n for s in found], "after": [_blob([s.after(k) for k in range(HEADS)]) for s in found]}
        yield pa.RecordBatch.from_pydict(data, schema=pa.schema({"p": pa.int32(), "place": pa.int32(), "c": pa.int64(), "n": pa.int64(), "after": pa.binary()}))

    out: dict[int, Border] = {}
    conv = task = state = None
    for r in sorted(rows.mapInArrow(outer, "p int, place int, c long, n long, after binary").collect(), key=lambda r: (r["p"], r["place"])):
        if r["c"] == conv:  # goes on from the task before
            out[task] = (*out[task][:4], True)
        else:
            state = (0, ONE, ONE)
        if r["place"] == 0:
            out[r["p"]] = (r["c"], *state, False)
        (n, own, head), after = state, _known(r["after"])
        state = (n + r["n"], then(own, after[min(max(head_turns(r["c"]) - n, 0), HEADS - 1)]), then(head, after[0]))
        conv, task = r["c"], r["p"]
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


_LONGS = pa.list_(pa.int64())
CHUNKS = pa.schema({"c": pa.int64(), "b": pa.int64(), "h": pa.int32(), "at": pa.int64(), "opens": pa.bool_(), "closes": pa.bool_(), "before": pa.binary(), "steps": pa.binary(), "k1": _LONGS, "k2": _LONGS, "chars": _LONGS})
HEAD_ROWS = pa.schema({"b": pa.int64(), "i": pa.int32(), "value": pa.binary(), "k1": pa.int64(), "k2": pa.int64(), "chars": pa.int64()})
NODE_ROWS = pa.schema({"d": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "p1": pa.int64(), "p2": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "chars": pa.int64(), "c": pa.int64(), "ends": pa.bool_()})
ENDS = pa.schema({"d": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "first": pa.int64(), "ids": pa.string()})
SHAS = pa.schema({"d": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "ends_sha256": pa.string()})


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string", _LONGS: "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def own_suffixes(rows: DataFrame, known: dict[int, Border]) -> DataFrame:
    """Chunks of each conversation's turns after its head: products from the first of them to each one.

    The chunk that opens a conversation and the one that closes it are there even where no turn follows the head.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)  # an entry for each task

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, p = [], None, None
        n, own, h, opens = 0, ONE, 0, False
        before, at, steps, turns = ONE, 0, [], []

        def told(closes: bool) -> None:
            nonlocal opens, before, at, steps, turns
            if steps or opens or closes:
                k1, k2, chars = zip(*turns) if turns else ((), (), ())
                out.append((conv, conv - int(np.fmod(conv, FAMILY)), h, at, opens, closes, _blob([before]), _blob(steps), k1, k2, chars))
            opens, before, at, steps, turns = False, own, at + len(steps), [], []

        for batch in batches:
            for p, c, k1, k2, digest, chars in _turns(iter([batch])):
                if c != conv:
                    first, goes_from, done, product, _, _ = (conv is None, *shared.value[p])
                    if conv is not None:
                        told(True)
                    n, own = (done, product) if first and goes_from == c else (0, ONE)
                    conv, h, opens, before, steps, turns = c, head_turns(c), n == 0, own, [], []
                    at = max(0, n - h)
                n += 1
                if n > h:
                    own = then(own, element(digest))
                    steps.append(own)
                    turns.append((k1, k2, chars))
                    if len(steps) == CHUNK:
                        told(False)
            if out:
                yield _batch(out, CHUNKS)
                out = []
        if conv is not None:
            told(not shared.value[p][4])
            yield _batch(out, CHUNKS)

    return rows.mapInArrow(products, _ddl(CHUNKS))


def base_heads(rows: DataFrame, known: dict[int, Border]) -> DataFrame:
    """(b, heads) of each base: the values of its first turns' products, in order, with the turns' classes."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, head = None, 0, ONE
        for batch in batches:
            out = []
            for p, c, k1, k2, digest, chars in _turns(iter([batch])):
                if c != conv:
                    goes_from, done, _, product, _ = shared.value[p]
                    n, head = (done, product) if conv is None and goes_from == c else (0, ONE)
                    conv = c
                n += 1
                if n < HEADS:
                    head = then(head, element(digest))
                    out.append((c, n, head[1].to_bytes(16, "big"), k1, k2, chars))
            yield _batch(out, HEAD_ROWS)

    found = rows.filter(F.col("c") % FAMILY == 0).mapInArrow(begun, _ddl(HEAD_ROWS))
    return found.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("i", "value", "k1", "k2", "chars"))).alias("heads"))  # HEADS - 1 at most


def rebuilt(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and depth: its prefix's name (f1, f2), that of the prefix before, the class and
    code points of the last turn, and whether the conversation ends there."""

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                values, before, rest = [], [], []
                for r in batch.slice(at, 256).to_pylist():
                    head = (r["heads"] or [])[: r["h"]]
                    below = [0, *(int.from_bytes(x["value"], "big") for x in head)]
                    start = below[-1]
                    last = (_known(r["before"])[0][0] * start + _known(r["before"])[0][1]) % PRIME
                    depth = len(head) + r["at"]
                    if r["opens"]:
                        values += below
                        before += [0, *below[:-1]]
                        rest += [(0, 0, 0, 0, r["c"], False), *((d, x["k1"], x["k2"], x["chars"], r["c"], False) for d, x in enumerate(head, 1))]
                    for (a, b), k1, k2, chars in zip(_known(r["steps"]), r["k1"], r["k2"], r["chars"]):
                        depth += 1
                        before.append(last)
                        values.append(last := (a * start + b) % PRIME)
                        rest.append((depth, k1, k2, chars, r["c"], False))
                    if r["closes"]:  # a mark beside the node's row, which other tasks may have
                        values.append(last)
                        before.append(0)
                        rest.append((depth, 0, 0, 0, r["c"], True))
                if not values:
                    continue
                (f1, f2), (p1, p2) = _pairs(values).T, _pairs(before).T
                d, k1, k2, chars, c, ends = zip(*rest)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((d, f1, f2, p1, p2, k1, k2, chars, c, ends), NODE_ROWS.types)], schema=NODE_ROWS)

    return chunks.join(heads, "b", "left").mapInArrow(combined, _ddl(NODE_ROWS))


def ending_ids(rows: DataFrame) -> DataFrame:
    """(d, f1, f2, ends_sha256): the hash of the ids of the conversations that end at a node, ascending and joined by commas.

    The ids of a node are joined by many tasks; the hash itself must read them in order, which one task does text by text.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["d", "f1", "f2"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for d, f1, f2, c in zip(*(batch.column(k).to_pylist() for k in (*key, "c"))):
                if ids and (node != (d, f1, f2) or len(ids) == TOLD):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = (d, f1, f2)
                ids.append(c)
            yield _batch(out, ENDS)
        if ids:
            yield _batch([(*node, ids[0], ",".join(map(str, ids)))], ENDS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for d, f1, f2, text in zip(*(batch.column(k).to_pylist() for k in (*key, "ids"))):
                if node == (d, f1, f2):
                    sha.update(b"," + text.encode())
                    continue
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = (d, f1, f2), hashlib.sha256(text.encode())
            yield _batch(out, SHAS)
        if node is not None:
            yield _batch([(*node, sha.hexdigest())], SHAS)

    ids = rows.filter("ends").select(*key, "c").repartitionByRange(n, *key, "c").sortWithinPartitions(*key, "c").mapInArrow(joined, _ddl(ENDS))
    return ids.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(hashed, _ddl(SHAS))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(d, f1, f2, p1, p2, m, n, chars, ends_sha256, sure): a row for each node; sure if its members have one parent and one
    class of last turns."""
    one = lambda k: F.min(k) == F.max(k)
    found = rows.filter("NOT ends").groupBy("d", "f1", "f2").agg(F.min("c").alias("m"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), (one("p1") & one("p2") & one("k1") & one("k2")).alias("sure"))
    return found.join(ending_ids(rows), ["d", "f1", "f2"], "left")


def chain_sums(links: DataFrame) -> DataFrame:
    """(m, leaves, saved): sums over all chains that hang, directly or not, on each chain and over itself.

    Round r adds what lies up to 2**r chains below, so there are as many rounds as the height has binary digits.
    """
    sums = links.select("m", F.col("pm").alias("up"), "leaves", "saved")
    while not sums.filter("up IS NOT NULL").isEmpty():
        below = sums.filter("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "over")
        further = sums.filter("up IS NOT NULL").select(F.col("m").alias("over2"), F.col("up").alias("next"))  # the root chain has nothing above it
        grown = sums.join(below, sums["m"] == below["over"], "left").join(further, F.col("up") == F.col("over2"), "left")
        add = lambda k: (F.col(k) + F.coalesce(f"more_{k}", F.lit(0))).alias(k)
        sums = checkpointed(grown.select("m", F.col("next").alias("up"), add("leaves"), add("saved")))
    return sums.drop("up")


def tree(nodes: DataFrame) -> DataFrame:
    """The trie's rows from its nodes."""
    first = F.min(F.struct("d", "p1", "p2"))
    gain = (F.col("n") - 1) * F.col("chars")
    chains = checkpointed(nodes.groupBy("m").agg(first.alias("first"), F.max("d").alias("bottom"), F.sum(gain).alias("gain")).select("m", F.col("first.d").alias("top"), "first.p1", "first.p2", "bottom", "gain"))
    root = chains.filter("top = 0").select("m").first()  # one chain has the root
    if root is None:
        root_id = F.lit(None).cast("long")
    else:
        root_id = F.lit(root["m"])
    # chains hang on the root by its name alone, so that it is no hot key; skew at other nodes is left to adaptive joins
    parents = nodes.select((F.col("d") + 1).alias("top"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("m").alias("pm"))
    deep = chains.filter("top > 1").join(parents.filter("top > 1"), ["top", "p1", "p2"])
    columns = ["m", "top", "bottom", "gain"]
    links = deep.select(*columns, "pm").unionByName(chains.filter("top <= 1").select(*columns, F.when(F.col("top") == 1, root_id).alias("pm")))
    hanging = links.filter("pm IS NOT NULL").groupBy(F.col("pm").alias("hm"), (F.col("top") - 1).alias("hd")).agg(F.count("*").alias("k"))
    links = checkpointed(links.join(hanging, (F.col("m") == F.col("hm")) & (F.col("bottom") == F.col("hd")), "left").select("m", "top", "bottom", "pm", F.when(F.col("k").isNull(), 1).otherwise(0).cast("long").alias("leaves"), F.col("gain").alias("saved")))
    totals = chain_sums(links)
    hung = links.select("m", "top", "pm").filter("pm IS NOT NULL").join(totals, "m").groupBy(F.col("pm").alias("m"), (F.col("top") - 1).alias("d")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    rows = nodes.select("m", "d", "n", gain.alias("gain"), "ends_sha256").join(links.select("m", "top", "bottom", "pm"), "m").join(hung, ["m", "d"], "left")
    none = lambda k: F.coalesce(k, F.lit(0))
    at_end = (F.col("d") == F.col("bottom")) & F.col("hung").isNull()
    rows = rows.withColumns({"block": F.floor(F.col("d") / BLOCK), "leaves": F.when(at_end, 1).otherwise(none("hung_leaves")), "saved": F.col("gain") + none("hung_saved")})
    down = Window.partitionBy("m", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.filter(F.floor(F.col("bottom") / BLOCK) > F.floor(F.col("top") / BLOCK)).groupBy("m", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    lower = Window.partitionBy("m").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # of long chains, a row for each BLOCK nodes
    lower = blocks.select("m", "block", F.sum("l").over(lower).alias("low_leaves"), F.sum("s").over(lower).alias("low_saved"))
    out = rows.withColumns({"sum_leaves": F.sum("leaves").over(down), "sum_saved": F.sum("saved").over(down)}).join(lower, ["m", "block"], "left")
    return out.select(
        F.col("m").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("top"), F.col("m")).otherwise(F.col("pm")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (none("hung") + F.when(F.col("d") < F.col("bottom"), 1).otherwise(0)).cast("long").alias("n_children"),
        (F.col("sum_leaves") + none("low_leaves")).alias("n_leaves"),
        (F.col("sum_saved") + none("low_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = 256) -> DataFrame:
    """The trie of all rebuilt conversations, a row for each node.

    conv_id is the smallest member, depth the number of turns; (conv_id, depth) names a node. parent_conv_id is the parent's
    conv_id (root: null), n_convs the members, n_children the children, n_leaves the childless nodes of the subtree,
    saved_tokens the sum over it of (n_convs - 1) times the code points of a node's last text, and ends_sha256 the hash of
    the decimal ids of those members that end there.

    A conversation's turns are ordered by number, nulls first, then by role and text; repeated rows are turns each. A null
    role or text is empty. Rows without a conversation belong to none and are left out. Other columns are not read. An empty
    table gives no rows. ``bits`` shortens the digests that classes and names are made of, for tests.
    """
    for attempt in itertools.count():
        salt, size = f"{attempt}|", 256 if attempt else bits
        rows = ordered(conversations, conv, turn, role, text, salt, size)
        if classes_hold(conversations.filter(F.col(conv).isNotNull()), role, text, salt, size):
            known = borders(rows)
            made = written(rebuilt(own_suffixes(rows, known), base_heads(rows, known)))
            nodes = written(nodes_of(made))
            discard(made)
            if nodes.filter("NOT sure").isEmpty():
                return tree(nodes)
            discard(nodes)
