"""Filters and greps over sections."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.stem import distinct_words, stem, stem_vocabulary, text_words
from tessera.operators.lookups import DELETIONS, looked_up, meeting
from tessera.operators.trigrams import narrowed
from tessera.plans.boolean import boolean_match
from tessera.plans.patterns import check_regex, heading_regex, path_matches
from tessera.plans.trigrams import of_pattern, of_query

ORDER = ("path", "start_line")


def search_sections(sections: DataFrame, heading: str | None = None, path: str | None = None, has_code: bool | None = None, has_list: bool | None = None, has_table: bool | None = None, min_level: int = 0, max_level: int = 6, limit: int | None = None) -> DataFrame:
    """Sections for which all given conditions hold, in order of (path, start_line)."""
    out = sections.filter(F.col("level").between(min_level, max_level))
    if heading is not None:
        out = out.filter(F.col("heading").rlike(f"(?i){check_regex(heading)}"))
    if path is not None:
        out = out.filter(path_matches(F.col("path"), path))
    for name, want in (("has_code", has_code), ("has_list", has_list), ("has_table", has_table)):
        if want is not None:
            out = out.filter(F.col(name) == want)
    return out if limit is None else out.orderBy(*ORDER).limit(limit)


def content_search(sections: DataFrame, query: str, trigrams: DataFrame | None = None) -> DataFrame:
    """Sections whose content satisfies a boolean query. With ``trigrams`` of the sections, those alone are read that hold
    what the query needs."""
    return narrowed(sections, trigrams, of_query(query)).filter(boolean_match(F.col("content"), query))


def section_lines(sections: DataFrame) -> DataFrame:
    """(section_id, path, line, text): the lines of each section, with the document's numbers."""
    return sections.select("section_id", "path", "start_line", F.posexplode(F.split("content", "\n")).alias("k", "text")).select("section_id", "path", (F.col("start_line") + F.col("k")).alias("line"), "text")


def regex_search(sections: DataFrame, pattern: str, trigrams: DataFrame | None = None) -> DataFrame:
    """Sections with a line that fits the pattern, case aside; ``trigrams`` as in content_search."""
    rule = f"(?i){check_regex(pattern)}"
    return narrowed(sections, trigrams, of_pattern(pattern)).filter(F.exists(F.split("content", "\n"), lambda line: line.rlike(rule)))


def match_context(lines: DataFrame, matches: Column, before: int = 1, after: int = 1, key: str = "section_id") -> DataFrame:
    """One row per matching line and line around it: match_line, line, text, is_match; clipped to the section."""
    w = Window.partitionBy(key).orderBy("line")
    # only lines near a match leave the window, so matches of frequent patterns don't multiply sections
    near = lines.withColumn("m", matches).withColumn("around", F.collect_list(F.when(F.col("m"), F.col("line"))).over(w.rangeBetween(-after, before)))
    return near.select(key, F.explode("around").alias("match_line"), "line", "text", (F.col("line") == F.col("match_line")).alias("is_match"))


def section_matches(sections: DataFrame, matches: Callable[[Column], Column], before: int = 1, after: int = 1, key: str = "section_id") -> DataFrame:
    """The same as match_context() straight from sections: lines are arrays in their rows, and nothing is shuffled."""
    lines = sections.select(key, "start_line", tx.once(F.split("content", "\n")).alias("lines"))
    hits = lines.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: matches(F.get("lines", i)))))
    around = hits.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - before), F.least(F.size("lines") - 1, F.col("at") + after))))
    return around.select(key, (F.col("start_line") + F.col("at")).alias("match_line"), (F.col("start_line") + F.col("k")).alias("line"), F.get("lines", F.col("k")).alias("text"), (F.col("k") == F.col("at")).alias("is_match"))


def _meets(word: Column, asked: Column, distance: int | None, stem_of: Column | None = None) -> Column:
    """Whether a word equals a query word (a struct of word and stem), is within the distance of it, or has its stem."""
    q = asked["word"]
    out = word == q
    if distance is not None:  # lengths are compared first
        out |= (F.abs(F.length(word) - F.length(q)) <= distance) & tx.within_distance(word, q, distance)
    return out if stem_of is None else out | (stem_of == asked["stem"])


def _asked(words: list[str]) -> Column:
    return F.array(*(F.struct(F.lit(w).alias("word"), F.lit(stem(w)).alias("stem")) for w in words))


def _meeting(vocabulary: DataFrame, asked: list[str], distance: int | None, stems: bool) -> DataFrame:
    """(word, query_word): which words of the vocabulary meet which words of the query, in one pass over it."""
    stem_of = F.col("stem") if stems else None
    met = F.transform(F.filter(_asked(asked), lambda q: _meets(F.col("word"), q, distance, stem_of)), lambda q: q["word"])
    return vocabulary.select("word", F.explode(met).alias("query_word"))


def fuzzy_words(vocabulary: DataFrame, words: list[str], distance: int = 2, word: str = "word") -> DataFrame:
    """(word, query_word) of the vocabulary within the distance of a query word."""
    return _meeting(vocabulary.select(F.col(word).alias("word")), list(dict.fromkeys(words)), distance, False)


def _split(query: str) -> list[str]:
    return [w for w in dict.fromkeys(re.split(r"[\W_]+", query.lower(), flags=re.ASCII)) if w]


def fuzzy_match(df: DataFrame, query: str, key: str = "section_id", text: str = "content", distance: int | None = 2, stems: bool = True, words: DataFrame | None = None, vocabulary: DataFrame | None = None, lookups: DataFrame | None = None) -> DataFrame:
    """Rows in whose text every query word has an equal word, one of the same stem, or one within the distance.

    Without stems this is a filter, and nothing is shuffled. Stems are worked out once for each distinct word; an index has
    ``words`` (key, word) and their ``vocabulary`` (word, stem), which are then looked up instead of the texts, and
    ``lookups`` of the vocabulary, of which distances up to lookups.DELETIONS read a few keys.
    """
    asked = _split(query)
    if not asked:
        return df.limit(0)
    if not stems and words is None:
        own = distinct_words(F.col(text))
        return df.filter(F.forall(_asked(asked), lambda q: F.exists(own, lambda w: _meets(w, q, distance))))
    if words is not None and lookups is not None and (distance or 0) <= DELETIONS:
        hits = looked_up(words, meeting(lookups, asked, distance, stems))
        full = hits.groupBy(key).agg(F.count_distinct("query_word").alias("n")).filter(F.col("n") == len(asked))
        return df.join(full.select(key), key, "left_semi")
    words = text_words(df, text, key) if words is None else words
    vocabulary = (stem_vocabulary(words) if stems else words.select("word").distinct()) if vocabulary is None else vocabulary
    meet = _meeting(vocabulary, asked, distance, stems)
    full = words.join(meet, "word").groupBy(key).agg(F.count_distinct("query_word").alias("n")).filter(F.col("n") == len(asked))
    return df.join(full.select(key), key, "left_semi")


def matched_words(lines: DataFrame, query: str, key: str, text: str = "text", distance: int | None = None, stems: bool = False) -> DataFrame:
    """(key, words): the words of each line that meet the query, in order; lines without any are left out."""
    asked = _split(query)
    if not stems:
        met = F.sort_array(F.filter(distinct_words(F.col(text)), lambda w: F.exists(_asked(asked), lambda q: _meets(w, q, distance))))
        return lines.select(key, tx.once(met).alias("words")).filter(F.size("words") > 0)
    words = text_words(lines, text, key)
    meet = _meeting(stem_vocabulary(words), asked, distance, stems)
    return words.join(meet.select("word").distinct(), "word").groupBy(key).agg(F.sort_array(F.collect_set("word")).alias("words"))


def highlight_words(df: DataFrame, query: str, key: str = "section_id", text: str = "content", distance: int | None = None, stems: bool = False, before: str = "**", after: str = "**") -> DataFrame:
    """Add marked: the text with the words that meet the query between marks, in their own case; one without stays."""
    met = matched_words(df, query, key, text, distance, stems).withColumnRenamed("words", "__words")
    # words are letters and digits alone, so they are patterns as they stand
    pattern = F.concat(F.lit("(?i)(?<![a-z0-9])("), F.array_join("__words", "|"), F.lit(")(?![a-z0-9])"))
    mark = lambda m: re.sub(r"([\\$])", r"\\\1", m)
    marked = F.regexp_replace(F.col(text), pattern, F.lit(f"{mark(before)}$1{mark(after)}"))
    return df.join(met, key, "left").withColumn("marked", F.when(F.col("__words").isNull(), F.col(text)).otherwise(marked)).drop("__words")


def refine(results: DataFrame, sections: DataFrame, terms: list[str], limit: int, order: list[Column]) -> DataFrame:
    """Results whose section holds all terms, the first ``limit`` in the given order."""
    holds = reduce(lambda a, b: a & b, (F.contains(F.lower("content"), F.lit(t.lower())) for t in terms), F.lit(True))
    return results.join(sections.filter(holds).select("section_id"), "section_id", "left_semi").orderBy(*order).limit(limit)


def _selected(selector: str) -> Column:
    number, heading = F.col("number"), F.col("heading")
    if all(p.isdigit() for p in selector.split(".")):
        return number == selector
    if "*" in selector or "?" in selector:
        return heading.rlike(heading_regex(selector))
    return F.lower(heading) == selector.lower()


def _within(sections: DataFrame, roots: DataFrame) -> DataFrame:
    """Sections that are a root or below one: an equi-join on each number's prefixes."""
    parts = F.split("number", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    up = sections.select("section_id", "path", F.explode(prefixes).alias("number"))
    return up.join(roots.select("path", "number").distinct(), ["path", "number"], "left_semi").select("section_id").distinct()


def select_sections(sections: DataFrame, selector: str, shallow: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """Sections by number, heading or glob, with what is below them unless ``shallow``; headings that only hold the
    selector are taken where none equals it."""
    roots = sections.filter(_selected(selector))
    if not ("*" in selector or "?" in selector or all(p.isdigit() for p in selector.split("."))):
        some = sections.filter(F.contains(F.lower("heading"), F.lit(selector.lower())))
        exact = roots.select("path").distinct().withColumn("exact", F.lit(True))
        roots = some.join(exact, "path", "left").filter(F.col("exact").isNull() | (F.lower("heading") == selector.lower())).drop("exact")
    out = roots if shallow else sections.join(_within(sections, roots), "section_id", "left_semi")
    return exclude_sections(out, exclude, sections)[0] if exclude else out


def exclude_sections(sections: DataFrame, patterns: list[str], tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sections less those that a pattern selects and what is below them, and per path how many went."""
    tree = sections if tree is None else tree
    hit = lambda p: _selected(p) | F.contains(F.lower("heading"), F.lit(p.lower())) if "*" not in p and "?" not in p else _selected(p)
    gone = _within(tree, tree.filter(reduce(lambda a, b: a | b, map(hit, patterns))))
    count = sections.join(gone, "section_id", "left_semi").groupBy("path").agg(F.count("*").alias("excluded"))
    return sections.join(gone, "section_id", "left_anti"), count


def section_context(results: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """Lines of the document around each result's section, clipped to the document: (section_id, line, text, inside)."""
    spans = results.select("section_id", "path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    own = lines.select("path", "line", "text")
    return spans.join(own, "path").filter(F.col("line").between(F.col("a") - before, F.col("b") + after)).select("section_id", "line", "text", F.col("line").between(F.col("a"), F.col("b")).alias("inside"))


def with_content(results: DataFrame, sections: DataFrame) -> DataFrame:
    """Results with the content of their sections; null where a section is gone."""
    return results.join(sections.select("section_id", "content"), "section_id", "left")
