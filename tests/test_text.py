from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.stem import stem
from tessera.plans import boolean, patterns


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("", 0),
        ("hello world", 4),  # 11 / 3.5 * 1.1
        ("a\nb", 2),
        ("```py\nx = 1\n```", 9),  # 6 + 5 / 2.5
        ("use `x` now", 6),
        ("/usr/bin/env", 7),
        ("日本", 3),
    ],
)
def test_token_count(spark, text, tokens):
    assert value(spark, tx.token_count(F.lit(text))) == tokens


def test_measures_of_nothing(spark):
    none = F.lit(None).cast("string")
    assert [value(spark, f(none)) for f in (tx.token_count, tx.word_count, tx.token_estimate)] == [0, 0, 0]
    assert value(spark, tx.word_count(F.lit("  two\n words "))) == 2


def test_identities(spark):
    assert value(spark, tx.slug(F.lit("Getting Started: a -- Guide!"))) == "getting-started-a-guide"
    assert value(spark, tx.normalized(F.lit("  a\t\tb\r\n\n\n\nc "))) == "a b\n\nc"
    assert value(spark, tx.preprocess_query(F.lit("How do I: café?"))) == "how do i caf"


def test_boosts(spark):
    assert value(spark, tx.heading_boost(F.lit("Error Handling"), F.lit("error handling guide"))) == pytest.approx(0.1)
    assert [value(spark, tx.file_boost(F.lit(p))) for p in ("README.md", "docs/index.md", "getting-started.md", "my-readme.md", "guide.md")] == [0.03, 0.03, 0.03, 0.0, 0.0]


@pytest.mark.parametrize("query, expands", [("how to fix it", True), ("auth", False), ('"how to do this"', False), ("one two three", False), ("one two three four five six", True), ("steps for install now", True)])
def test_expansion_gate(spark, query, expands):
    assert value(spark, tx.should_expand(F.lit(query))) is expands


def test_edit_distance(spark):
    assert value(spark, tx.within_distance(F.lit("Kitten"), F.lit("sitting"), 3)) is True
    assert value(spark, tx.within_distance(F.lit("kitten"), F.lit("sitting"), 2)) is False


@pytest.mark.parametrize("word, root", [("running", "run"), ("failures", "failur"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("generalizations", "gener"), ("configuration", "configur"), ("agreed", "agre"), ("as", "as")])
def test_stems(word, root):
    assert stem(word) == root


@pytest.mark.parametrize(
    "glob, path, fits",
    [("*.md", "a.md", True), ("*.md", "docs/a.md", False), ("**/*.md", "docs/a.md", True), ("docs/**/*.md", "docs/a.md", False), ("docs/?.md", "DOCS/a.MD", True), ("a.b", "axb", False), ("docs/**", "docs/x/y", True)],
)
def test_path_globs(spark, glob, path, fits):
    assert value(spark, patterns.path_matches(F.lit(path), glob)) is fits


@pytest.mark.parametrize("pattern", ["(a+)+", "(a+)+$", "(.*a){20}", "(a|a)+", "(a|ab)*", "(.|x)*", r"(.|\s)+", "((a+)b?)+$", "((a*))*x", "(?:a|[a-c]x)+", "(x(y|yz)){2,}", "(?i)(?:A1|a2|b)+", "(", "a" * 201])
def test_regex_guard_rejects(pattern):
    with pytest.raises(ValueError):
        patterns.check_regex(pattern)


def test_regex_guard_takes_plain_patterns():
    for pattern in (r"^err(or)?s? \d+", "a+", "test.*file", "(ab|cd)+", "(abc){3}", r"(\d{4}-)+", "(a|b)*", "x(y+)z?", "[a-z]+@[a-z]+"):
        assert patterns.check_regex(pattern) == pattern


@pytest.mark.parametrize(
    "path, gone",
    [("node_modules/x.md", True), ("a/node_modules/x.md", True), ("drafts/x.md", True), ("drafts/keep.md", False), ("a/notes.tmp.md", True), ("a/b.md", False), ("top/only.md", True), ("x/top/only.md", False), ("gone/keep.md", True), ("a/b/gone/x/keep.md", True), ("log/a/b/x.log.md", True), ("log/a.md", False)],
)
def test_ignore_rules(spark, path, gone):
    rules = ["node_modules", "# comment", "", "drafts/*", "!drafts/keep.md", "*.tmp.md", "/top/", "gone/", "!gone/keep.md", "!keep.md", "log/**/*.log.md"]
    assert value(spark, patterns.ignored(F.lit(path), rules)) is gone


@pytest.mark.parametrize(
    "query, text, fits",
    [
        ("auth AND token", "Authentication tokens", True),
        ("auth token", "auth only", False),
        ("a OR b AND c", "a", True),
        ("NOT draft", "final", True),
        ("x NOT y", "x y", False),
        ('"exact phrase"', "an EXACT phrase here", True),
        ("(a OR b) c", "b c", True),
        ("", "anything", False),
    ],
)
def test_boolean_queries(spark, query, text, fits):
    assert value(spark, boolean.boolean_match(F.lit(text), query)) is fits


def test_highlights(spark):
    assert value(spark, boolean.highlight(F.lit("Authority and auth"), "auth")) == "Authority and **auth**"
    assert value(spark, boolean.highlights(F.lit("x"), "")) == []


def test_highlighted_words(spark):
    from tessera.operators import filters

    df = spark.createDataFrame([(1, "Running, runs; outrun RUN $5"), (2, "none"), (3, None)], "section_id int, content string")
    marked = lambda **more: {r.section_id: r.marked for r in filters.highlight_words(df, "run", **more).collect()}
    assert marked(stems=True) == {1: "**Running**, **runs**; outrun **RUN** $5", 2: "none", 3: None}
    assert marked() == {1: "Running, runs; outrun **RUN** $5", 2: "none", 3: None}
    assert marked(distance=1, before="<$", after="\\>")[1] == "Running, <$runs\\>; outrun <$RUN\\> $5"
