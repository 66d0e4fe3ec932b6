"""Words by what is left of them when letters are deleted, so that fuzzy lookup is a lookup of keys and a check.

Words within edit distance d have a common rest after at most d deletions in each: every edit costs either word one letter.
This holds of their first ``PREFIX`` letters as well, since what an alignment moves over the border costs an insertion that
is already counted; so a word of any length has no more keys than its beginning gives. (After Mor and Fraenkel, "A hash
code method for detecting and correcting spelling errors", 1982.) A word is also found by its stem.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.stem import stem

#: Letters of a word that are looked at, and deletions of them; and what keys of either kind begin with.
PREFIX, DELETIONS = 7, 2
REST, STEM = "~", "="
#: Keys, and words found, that are looked up by a filter that reaches the scan.
MOST_LOOKED_UP = 500


def rests(word: str, deletions: int = DELETIONS) -> list[str]:
    """What is left of the first letters of a word after up to so many deletions."""
    head = word[:PREFIX]
    return sorted({"".join(c for i, c in enumerate(head) if i not in gone) for k in range(deletions + 1) for gone in combinations(range(len(head)), k)})


def _rests(word: Column) -> Column:
    """``rests`` of a column."""
    head = F.substring(word, 1, PREFIX)
    without = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.lit(PREFIX))))
    out, last = F.array(head), F.array(head)
    for _ in range(DELETIONS):
        last = F.array_distinct(F.flatten(F.transform(last, without)))
        out = F.array_union(out, last)
    return out


def lookup_rows(vocabulary: DataFrame) -> DataFrame:
    """(key, word) of a vocabulary (word, stem): each word under the rests of its beginning and under its stem."""
    keys = F.concat(F.transform(_rests(F.col("word")), lambda r: F.concat(F.lit(REST), r)), F.array(F.concat(F.lit(STEM), "stem")))
    return vocabulary.select(F.explode(keys).alias("key"), "word")


def meeting(lookups: DataFrame, asked: list[str], distance: int | None, stems: bool) -> DataFrame:
    """(word, query_word): which words meet which words of a query: equal, of the same stem, or within the distance.

    Of the lookups only rows with a key of the query are read. The distance is at most ``DELETIONS``.
    """
    if (distance or 0) > DELETIONS:
        raise ValueError(f"a lookup tells words within {DELETIONS} edits")
    keys = {w: [REST + r for r in rests(w, distance or 0)] for w in asked}
    wanted = sorted({k for own in keys.values() for k in own} | ({STEM + stem(w) for w in asked} if stems else set()))
    found = lookups.filter(F.col("key").isin(wanted))
    near = lambda w: F.col("word") == w if not distance else tx.within_distance(F.col("word"), F.lit(w), distance)
    of = lambda w: (F.col("key").isin(keys[w]) & near(w)) | (F.col("key") == (STEM + stem(w) if stems else ""))
    met = F.array_compact(F.array(*(F.when(of(w), F.lit(w)) for w in asked)))
    return found.select("word", F.explode(met).alias("query_word")).distinct()


def looked_up(words: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of ``words`` whose word was met, with query_word. Of few words, by a filter that reaches the scan."""
    few = met.limit(MOST_LOOKED_UP + 1).collect()
    if len(few) > MOST_LOOKED_UP:
        return words.join(met, "word")
    pairs = words.sparkSession.createDataFrame([tuple(r) for r in few], "word string, query_word string")
    return words.filter(F.col("word").isin(sorted({r["word"] for r in few}))).join(F.broadcast(pairs), "word")
