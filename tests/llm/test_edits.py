"""Fill-in-the-middle transformation and order-sensitive fingerprints."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle, order_minhash
from tests.llm.conftest import prose

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = st.text(alphabet=" \t\n\x0b\x0c\r\x08\x0e\x1f!\x00\x7f\x80\x85\xa0aé漢😀", max_size=40)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


# Fill in the middle


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=12))
def test_units_are_those_of_the_pattern(texts):
    units = fill_in_middle.Units([t.encode("utf-8") for t in texts])
    tokens = [TOKEN.findall(t) for t in texts]
    assert units.n.tolist() == [len(t) for t in tokens]
    for k in range(max(map(len, tokens)) + 1):
        taken = [min(k, len(t)) for t in tokens]
        assert units.end(np.array(taken)).tolist() == [len("".join(t[:n]).encode("utf-8")) for t, n in zip(tokens, taken)]


def fim_brute(key, text, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (key, len(tokens), "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < spm else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return (key, len(tokens), form, len(prefix), len(middle), sha(out), sha(text))


def test_fill_in_middle_brute(spark, messy):
    odd = [(100 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "< P>", "ends with <", "<S", " ", "a ", " a", "\x85x\xa0y", "漢 字\t", "P><"])]
    odd += [(i, "cut < S> me <S into < parts P> here ") for i in range(200, 260)] + [(None, "no id at all"), (None, "no id at all"), (7, None), (-5, "less than none")]
    rows = messy + odd
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n long, output string, `__cut` string")
    have = [tuple(r) for r in fill_in_middle.digest(df).collect()]
    assert Counter(have) == Counter(fim_brute(*r) for r in rows)
    assert {r[2] for r in have} == {"plain", "psm", "spm"}
    full = fill_in_middle.transform(df, rate=100, spm=50)
    assert set(full.columns) == {"doc_id", "text", "__cut", "n", "form", "prefix_chars", "middle_chars", "output"} and full.filter("`__cut` = 'y'").count() == len(rows)
    assert full.filter(~fill_in_middle.restored().eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert full.filter("form <> 'plain'").count() > 60 and full.limit(0).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(df.withColumnRenamed("text", "form2"), text="output")


def test_fill_in_middle_pieces(spark, monkeypatch):
    raw = [b"a" * n for n in (5, 0, 30, 3, 9, 50, 1)]
    monkeypatch.setattr(fill_in_middle, "PIECE_BYTES", 12)
    edges = fill_in_middle._pieces(raw)
    assert edges[0] == 0 and edges[-1] == len(raw) and all(b - a == 1 or sum(map(len, raw[a:b])) <= 12 for a, b in zip(edges, edges[1:]))


# Order MinHash


def brute_fingerprint(text, k=order_minhash.K):
    """One k-mer and one entry at a time."""
    wrap, size = 2**64, min(k, len(text))
    grams = [text[i : i + size] for i in range(len(text) - size + 1)]
    named = {g: int(order_minhash.kmers(np.frombuffer(g.encode("utf-32-le"), "<u4"))[0]) for g in set(grams)}
    seen, numbers = Counter(), []
    for g in grams:
        x = (named[g] + seen[g] * 0x9E3779B97F4A7C15) % wrap
        numbers.append(((x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % wrap) >> 32)
        seen[g] += 1
    out = []
    for odd in order_minhash.Permutations().odd[:, 0].tolist():
        lowest = sorted(range(len(grams)), key=lambda i: (numbers[i] * odd % 2**32, i))[: order_minhash.TOGETHER]
        entry = np.zeros(1, np.uint64)
        for i in sorted(lowest):
            entry = order_minhash.mixed(entry * np.uint64(0x9E3779B97F4A7C15) + np.uint64(named[grams[i]]))
        out.append(int(order_minhash.mixed(entry)[0]) >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaa", "the cat saw the cat and the cat saw the dog " * 3, "漢字😀é" * 9])
def test_entries_are_the_smallest_pairs_in_text_order(text):
    assert order_minhash.Permutations().fingerprint(text).tolist() == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcé漢 ", max_size=120), st.text(alphabet="abcé漢 ", max_size=60))
def test_shared_beginnings_change_no_fingerprint(text, after):
    sketch = order_minhash.Permutations()
    cut = len(text) // 4
    edited = text[: len(text) - cut] + after[:cut]
    own, other = sketch.both(text, edited, len(text) - cut)
    assert (own == sketch.fingerprint(text)).all() and (other == sketch.fingerprint(edited)).all()


def test_order_and_repeats_count():
    rng = random.Random(3)
    sketch = order_minhash.Permutations()
    parts = [prose(rng, 60) for _ in range(8)]
    like = lambda a, b: float((sketch.fingerprint(a) == sketch.fingerprint(b)).mean())
    text = " ".join(parts)
    assert like(text, " ".join(reversed(parts))) < 0.75 < like(text, text.replace(parts[3][:9], "another w"))
    assert like(text, prose(rng, 480)) < 0.05
    assert like("abcdefgh" * 10, "abcdefgh" * 40) < 0.6  # occurrences count
    block = order_minhash.BLOCK
    long = prose(rng, 3000)
    order_minhash.BLOCK = 64
    try:
        small = order_minhash.Permutations().fingerprint(long)
    finally:
        order_minhash.BLOCK = block
    assert (small == sketch.fingerprint(long)).all()


def edits_brute(rows):
    sketch = order_minhash.Permutations()
    out = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = map(sketch.fingerprint, (text, edited, after))
        out.append((key, len(text), sha(edited), order_minhash.as_hex(a), order_minhash.as_hex(b), float((a == b).mean()), float((a == c).mean())))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 200])
def test_compare_edits_brute(spark, messy, partitions):
    df = spark.createDataFrame([(*r, "x", 1) for r in messy], "doc_id long, text string, fingerprint string, key long").repartition(5)
    have = order_minhash.compare_edits(df, partitions=partitions)
    want = edits_brute([(i, t or "") for i, t in sorted(messy, key=lambda r: r[0])])
    assert have.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, have.collect())) == sorted(want)


def test_compare_edits_odd_tables(spark):
    schema = "doc_id long, text string"
    one = order_minhash.compare_edits(spark.createDataFrame([(5, "abcdefghijkl" * 3)], schema)).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(5, 1.0)]
    assert order_minhash.compare_edits(spark.createDataFrame([], schema)).count() == 0
    ties = [(None, "none of them has an id"), (None, None), (3, "same id, one text of two"), (3, "same id, the other text"), (3, "same id, the other text"), (9, "the last one of all of these")]
    for partitions in (1, 2, 6):
        have = order_minhash.compare_edits(spark.createDataFrame(ties, schema), partitions=partitions).collect()
        assert Counter((r["doc_id"], r["n_chars"]) for r in have) == Counter((i, len(t or "")) for i, t in ties)
        hashes = {r["text"]: r["h"] for r in spark.createDataFrame(ties, schema).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        rows = sorted(ties, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
        key = lambda r: (r[0] is not None, *r[:1]) if r[0] is not None else (False, 0)
        assert sorted((tuple(r) for r in have), key=lambda r: (key(r), r[1:])) == sorted(edits_brute([(i, t or "") for i, t in rows]), key=lambda r: (key(r), r[1:]))


def test_likeness_of_columns(spark, messy_df, messy):
    prints = order_minhash.with_fingerprint(messy_df)
    by_id = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert by_id[10] == by_id[11] and len(by_id) == len(messy) and {len(f) for f in by_id.values()} == {8 * order_minhash.ENTRIES}
    pair = spark.createDataFrame([(by_id[10], by_id[12]), (by_id[10], by_id[11]), (by_id[10], by_id[33])], "a string, b string")
    near, same, far = (r[0] for r in pair.select(order_minhash.likeness(F.col("a"), F.col("b"))).collect())
    sketch = order_minhash.Permutations()
    assert same == 1.0 and far < 0.1 and near == float((sketch.fingerprint(dict(messy)[10]) == sketch.fingerprint(dict(messy)[12])).mean()) > 0.7
