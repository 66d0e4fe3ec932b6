"""Trigram formulas never rule out a text that fits, and rule out most that don't."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import filters, trigrams
from tessera.plans.trigrams import grams, of_pattern, of_query, of_string

PATTERNS = ["abc", "ab+c", "(abc|bca)d?a", "a.c", "abca{2,3}b", "(?:abc)+ab", "^abc$", r"\babc\b", "ab[cd]abc", "abc*", "(abc)?bcd", "a|bcd", "abc(?=d)", "(?i)ABC", "éabc", "(a(b(cab)))", "abc|abd", "x*", "[abc]abcd"]


def fits(text: str, formula) -> bool:
    if formula is None:
        return True
    if isinstance(formula, str):
        return formula in {text[i : i + 3] for i in range(len(text) - 2)}
    return (all if formula[0] == "and" else any)(fits(text, p) for p in formula[1])


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(PATTERNS), st.text(alphabet="abcdABé ", max_size=30))
def test_no_text_that_fits_a_pattern_is_ruled_out(pattern, text):
    if re.search(pattern, text, re.IGNORECASE):
        assert fits(text.lower(), of_pattern(pattern))


def test_formulas():
    assert of_string("ab") is None and of_string("abc") == "abc" and of_string("ABCD") == ("and", ("abc", "bcd"))
    assert of_query("cat AND (dog OR bird)") == ("and", ("cat", ("or", ("dog", ("and", ("bir", "ird"))))))
    assert of_query("cat NOT dog") == "cat" and of_query("cat OR it") is None and of_query("") is None and of_query("NOT cat") is None
    assert of_query('"a cat"') == ("and", ("a c", " ca", "cat"))
    assert of_pattern("abc.def") == ("and", ("abc", "def")) and of_pattern("(abc|def)") == ("or", ("abc", "def")) and of_pattern("(abc|d)") is None
    assert of_pattern("ab+cde") == "cde" and of_pattern("a(bc)d") == ("and", ("abc", "bcd")) and of_pattern("a{3}") is None and of_pattern("x*") is None
    assert grams(("and", ("abc", ("or", ("bcd", "abc"))))) == ["abc", "bcd"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("a", "The cat sat.\nA dog ran"), ("b", "the DOG and the bird"), ("c", None), ("d", ""), ("e", "ca t"), ("f", "catalogue of birds\nÉtude 漢字漢"), ("g", "cat\ndog")]
    rows += [(f"n{i}", f"nothing of interest number {i}") for i in range(40)]
    return spark.createDataFrame(rows, "section_id string, content string")


def test_rows(spark, texts):
    found = trigrams.trigram_rows(texts)
    assert sorted(r.gram for r in found.filter("section_id = 'e'").collect()) == ["a t", "ca "]
    assert {"漢字漢", "étu", "ds\n"} <= {r.gram for r in found.filter("section_id = 'f'").collect()} and found.filter("section_id IN ('c', 'd')").count() == 0


@pytest.mark.parametrize("most", [500, 0])
def test_searches_find_the_same(spark, texts, monkeypatch, tmp_path, most):
    monkeypatch.setattr(trigrams, "MOST_LOOKED_UP", most)
    index = trigrams.index_trigrams(texts, str(tmp_path))
    ids = lambda df: sorted(r.section_id for r in df.select("section_id").collect())
    for query in ("cat", "cat dog", "cat OR bird", "dog NOT cat", '"the cat"', "zzz", "NOT cat", "of", "", "étude OR 漢字漢"):
        assert ids(filters.content_search(texts, query, index)) == ids(filters.content_search(texts, query)), query
    for pattern in ("cat|bird", "^a dog", r"c.t", "dog$", "bir(d|ds)$", "number 1[0-9]", "zzzz"):
        assert ids(filters.regex_search(texts, pattern, index)) == ids(filters.regex_search(texts, pattern)), pattern
    kept = lambda formula: trigrams.candidates(index, formula).count()
    assert kept(of_query("cat")) == 3 and kept(of_pattern("bir(d|ds)$")) == 2 and trigrams.candidates(index, None) is None


def test_fewer_texts_are_read(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").cast("string").alias("section_id"), F.col("text").alias("content"))
    index = trigrams.index_trigrams(docs, str(tmp_path))
    assert trigrams.candidates(index, of_query("idiot")).count() == docs.filter(F.contains(F.lower("content"), F.lit("idiot"))).count() < 0.3 * docs.count()


def test_trigrams_are_sorted_by_the_gram_alone(spark, tmp_path, monkeypatch):
    """A sort by ids as well took twice the time; files are in order of the gram, and hold every gram of their sections."""
    kind, by = type(spark.range(1)), []
    sort = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda df, *cols: by.append(cols) or sort(df, *cols))
    own = spark.createDataFrame([(f"s{i}", f"abcd {i} bcde") for i in range(30)], "section_id string, content string").repartition(2)
    found = trigrams.index_trigrams(own, str(tmp_path))
    assert by == [("gram",)] and sorted(map(tuple, found.collect())) == sorted(map(tuple, trigrams.trigram_rows(own).collect()))
    for file in found.inputFiles():
        grams_of = [r.gram for r in spark.read.parquet(file).collect()]
        assert grams_of == sorted(grams_of)
