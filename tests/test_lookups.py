"""Fuzzy lookup by deletion keys against edit distances of whole vocabularies."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.stem import stem_vocabulary, text_words
from tessera.operators import filters, lookups

LETTERS = st.text(alphabet="abcd", max_size=11)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.sampled_from("idc"), st.integers(0, 12), st.sampled_from("abcd")), max_size=2))
def test_words_within_the_distance_share_a_rest(word, edits):
    other = word
    for kind, at, letter in edits:
        at = min(at, len(other))
        other = other[:at] + {"i": letter + other[at:], "d": other[at + 1 :], "c": letter + other[at + 1 :]}[kind]
    d = distance(word, other)
    if d <= 2:
        assert set(lookups.rests(word)) & set(lookups.rests(other, d))


def test_rests_of_columns_are_those_of_words(spark):
    words = ["", "a", "ab", "aab", "abcdefg", "abcdefghijkl", "été漢字x", "aaaaaaaa"]
    rows = spark.createDataFrame([(w, w) for w in words], "word string, stem string")
    have = {}
    for r in lookups.lookup_rows(rows).collect():
        have.setdefault(r["word"], []).append(r["key"])
    for w in words:
        assert sorted(have[w]) == sorted([f"~{r}" for r in lookups.rests(w)] + [f"={w}"])


@pytest.mark.parametrize("within, stems", [(2, False), (1, False), (None, True), (2, True), (1, True), (0, False)])
def test_lookup_finds_what_the_whole_vocabulary_gives(spark, data, within, stems):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("section_id"), F.col("text").alias("content"))
    words = text_words(docs, "content", "section_id")
    vocabulary = stem_vocabulary(words).cache()
    keys = lookups.lookup_rows(vocabulary)
    asked = ["that", "idiots", "the", "er", "stupidity", "internationally", "x"]
    want = {tuple(r) for r in filters._meeting(vocabulary, asked, within, stems).collect()}
    have = [tuple(r) for r in lookups.meeting(keys, asked, within, stems).collect()]
    assert set(have) == want and len(have) == len(want) and want
    for query in ("idiots the", "stupid", "nowherewordsuch", ""):
        old = filters.fuzzy_match(docs, query, distance=within, stems=stems, words=words, vocabulary=vocabulary)
        new = filters.fuzzy_match(docs, query, distance=within, stems=stems, words=words, lookups=keys)
        ids = lambda df: sorted(r[0] for r in df.select("section_id").collect())
        assert ids(old) == ids(new)


def test_many_words_are_joined_and_wide_distances_refused(spark, monkeypatch):
    monkeypatch.setattr(lookups, "MOST_LOOKED_UP", 2)
    words = spark.createDataFrame([(i, w) for i, w in enumerate("cat bat rat hat mat dog".split())], "section_id int, word string")
    keys = lookups.lookup_rows(stem_vocabulary(words))
    met = lookups.meeting(keys, ["cat"], 1, False)
    assert sorted(r["word"] for r in lookups.looked_up(words, met).collect()) == ["bat", "cat", "hat", "mat", "rat"]
    with pytest.raises(ValueError):
        lookups.meeting(keys, ["cat"], 3, False)
