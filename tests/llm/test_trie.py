"""The prefix trie of rebuilt conversations against one that is built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest

from tessera.llm import conversation_trie
from tests.compare import rows

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(table):
    turns = {}
    for c, t, role, text in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        turns.setdefault(c, []).append((role or "", text or ""))
    nodes = {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    value = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in nodes.items()}
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p in nodes:
        for d in range(len(p) + 1):
            saved[p[:d]] += value[p]
            leaves[p[:d]] += not kids[p]
    return sorted((m[0][0], len(p), nodes[p[:-1]][0][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c, ends in m if ends).encode()).hexdigest()) for p, m in nodes.items())


def key(r):
    return (r[1], r[0])


def check(spark, table, **options):
    have = conversation_trie.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(3), **options)
    assert have.columns == NAMES
    assert sorted(map(tuple, have.collect()), key=key) == sorted(brute(table), key=key)


@pytest.fixture(scope="module")
def talks():
    """Copies, shared beginnings, lost bases, ties, repeated rows, nulls, and one conversation of thousands of turns."""
    rng = random.Random(9)
    say = lambda: rng.choice(["yes", "no", "well?", "", None, "a longer answer, with é and 漢字"])
    who = lambda: rng.choice(["user", "assistant", None])
    table = []
    for c in [*range(0, 60), 100, 101, 102, 177, *range(300, 330), 1234, 1240, -5, -100, -130]:
        table += [(c, t, who(), say()) for t in range(rng.choice([1, 2, 3, 7, 9]))]
    for c in range(400, 430):  # copies
        table += [(c, t, "user", f"turn {t}") for t in range(8)]
    table += [(430, t, "user", f"turn {t}") for t in range(20)]
    table += [(500, None, "user", "no number"), (500, None, "user", None), (500, 0, None, "first"), (500, 1, "b", "tie"), (500, 1, "a", "tie"), (500, 1, "a", "tie"), (500, 1, "a", "a" * 70 + "2"), (500, 1, "a", "a" * 70 + "1")]
    table += [(c, t, "user", "same") for c in (600, 601, 602, 700) for t in range(2600 if c == 700 else 30)]
    table += [(None, 0, "user", "nobody's"), (None, 1, None, None)]
    return table


def test_trie_brute(spark, talks):
    check(spark, talks)


def test_trie_of_long_conversations_over_many_tasks(spark, monkeypatch):
    """Stretches of one conversation lie in many tasks, chunks and blocks; heads too cross the borders of tasks."""
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)
    monkeypatch.setattr(conversation_trie, "BLOCK", 8)
    monkeypatch.setattr(conversation_trie, "TOLD", 3)
    rng = random.Random(4)
    table = [(c, t, "user", f"{t}") for c in (200, 203, 205, 211) for t in range(60)]
    table += [(c, t, "user", f"{t}" if t < 20 else rng.choice("ab")) for c in range(220, 240) for t in range(30)]
    table += [(c, 0, "user", "hi") for c in range(800, 860)] + [(c, t, "x", "") for c in (900, 901) for t in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        check(spark, table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_nested_chains(spark):
    """Each conversation leaves the one before it a turn later, so that chains hang on chains many times over."""
    table = []
    for k in range(40):
        c = 101 + 100 * k  # no base is there
        h = zlib.crc32(str(c).encode()) % 6
        table += [(c, t - h, "user", "head" if t < h else f"left {t - h - 1}" if t - h < k else f"own {k}") for t in range(h + k + 2)]
    check(spark, table)


def test_collisions_are_seen(spark, talks, monkeypatch):
    """With digests of four bits, classes have several texts; then all is done with whole digests."""
    asked = []
    real = conversation_trie.classes_hold
    monkeypatch.setattr(conversation_trie, "classes_hold", lambda *a: asked.append(real(*a)) or asked[-1])
    check(spark, talks[:80], bits=4)
    assert asked == [False, True]


def test_prefixes_that_collide_are_seen(spark):
    """A name with several parents, or with several classes of last turns, isn't sure."""
    schema = "d long, f1 long, f2 long, p1 long, p2 long, k1 long, k2 long, chars long, c long, ends boolean"
    members = [(1, 1, 1, 0, 0, 7, 7, 3, c, False) for c in (1, 2)] + [(2, 1, 1, 1, p, 7, 7, 3, p, False) for p in (1, 2)] + [(3, 1, 1, 1, 1, 7, k, 3, k, False) for k in (1, 2)]
    nodes = conversation_trie.nodes_of(spark.createDataFrame(members, schema))
    assert {r["d"]: r["sure"] for r in nodes.collect()} == {1: True, 2: False, 3: False}


def test_odd_tables(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(7, None, None, None)])
    check(spark, [(None, 1, "a", "b")])
    extra = spark.createDataFrame([(3, 0, "user", "x", 1, "y"), (4, 0, "user", "x", 2, "z")], SCHEMA + ", m int, d string")
    have = conversation_trie.prefix_trie(extra)
    assert rows(have.toPandas()) == rows(spark.createDataFrame(brute([(3, 0, "user", "x"), (4, 0, "user", "x")]), ", ".join(f"{n} {'string' if n == 'ends_sha256' else 'long'}" for n in NAMES)).toPandas())
    long = "very long " * 200_000
    check(spark, [(c, t, "user", long) for c in (1, 2) for t in range(7)])
