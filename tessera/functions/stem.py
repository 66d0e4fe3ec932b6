"""Porter stems (M. F. Porter, "An algorithm for suffix stripping", 1980), worked out once for each distinct word."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The suffixes of the second, third and fourth step.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize"
_TWO, _THREE = ([tuple(p.split(":")) for p in s.split()] for s in (STEP_2, STEP_3))


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word, in lower case; words of one or two letters stay."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (_TWO, _THREE):
        for end, new in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(STEP_4.split(), key=len, reverse=True):
        if w.endswith(end):
            base = w[: -3] if end in ("sion", "tion") else w[: -len(end)]
            if _measure(base) > 1:
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def with_stems(words: DataFrame, word: str = "word") -> DataFrame:
    """Add stem to rows that have a word."""

    @F.pandas_udf("string")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(stem)

    return words.withColumn("stem", stems(word))


def stem_vocabulary(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of the distinct words; null words are left out."""
    return with_stems(words.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct())


def distinct_words(text: Column) -> Column:
    """The distinct words of a text: runs of letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\W_]+"), lambda w: w != ""))


def text_words(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, word) of the distinct words of each text."""
    return df.select(*keys, F.explode(distinct_words(F.col(text))).alias("word"))


def stems(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, stems): the distinct stems of each text, in order."""
    words = text_words(df, text, key)
    return words.join(stem_vocabulary(words), "word").groupBy(key).agg(F.sort_array(F.collect_set("stem")).alias("stems"))
