"""Quality rules with adaptive thresholds, in DataFrame operations alone.

Measures of each document are gathered into quantile sketches with logarithmic buckets of relative error ``ACCURACY``
(after Masson, Rim and Lee, "DDSketch", 2019). A sketch is a table of (bucket, count), so sketches merge by adding counts:
those of (lang, source) merge into those of a language and of all documents, which stand in where a source has few
documents. From their quartiles come fences, which replace fixed cutoffs; these are joined to the documents and filter them.

Lengths (n_words by its logarithm, word_length) have a fence ``WIDTHS`` interquartile ranges beyond each quartile. The shares
of symbols, of equal lines and of repeated words are 0 in most documents, so their ranges are too; their upper fence stands
``TAIL`` of the way from the 90th to the 99th percentile, where a group's few odd documents part from its many. A group
without such a tail takes the fence of the next level up, and none if there is no tail anywhere. The error of a quantile
counts in a document's favour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, WORD, apart, checkpointed, written

#: Relative error of a quantile, the smallest value kept apart from 0, and the documents a source needs.
ACCURACY, LEAST, ENOUGH = 0.01, 1e-6, 20
#: Interquartile ranges between a quartile and its fence; the place of a share's fence between its 90th and 99th percentiles.
WIDTHS, TAIL = {"n_words": 2.0, "word_length": 4.0}, 0.75
SHARES = ("symbol_share", "dup_line_share", "repeat_share")
FENCED = (*WIDTHS, *SHARES)
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Fences of more sources than this aren't broadcast.
MOST_BROADCAST = 200_000
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and __n_lines (lines with a word)."""
    t = _text(text)
    lines = F.filter(F.split(t, "\n"), lambda line: _without(line, SPACES) != "")
    out = df.withColumns({"n_words": F.regexp_count(t, F.lit(WORD)).cast("long"), "word_chars": F.char_length(_without(t, SPACES)).cast("long"), "n_symbols": (F.char_length(t) - F.char_length(_without(t, SYMBOLS))).cast("long"), "__lines": lines})
    return out.withColumns({"__n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__lines")


def with_repeats(df: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """Add n_repeat_words: words in windows of ``size`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Only a text with an equal pair has its windows sorted; the words
    covered are then counted from the gaps between the places of the equal windows.
    """
    words = F.filter(F.split(_text(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(F.slice("__words", 1, F.greatest(F.size("__words") - (size - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get("__words", i + k) for k in range(1, size))))
    rows = F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda g, k: F.coalesce(F.get("__sorted", k - 1)["h"] == g["h"], F.lit(False)) | F.coalesce(F.get("__sorted", k + 1)["h"] == g["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("__sorted", same), lambda g: g["i"]))
    covered = F.aggregate(F.transform("__places", lambda p, k: F.least(F.coalesce(F.get("__places", k + 1) - p, F.lit(size)), F.lit(size)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = df.withColumn("__words", words).withColumn("__hashes", hashes)
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), rows).otherwise(empty))
    # the row's number makes the count one that no filter is pushed below: there it would be worked out anew for each word
    counted = F.when(F.monotonically_increasing_id() >= 0, covered)
    return out.withColumn("__places", places).withColumn("n_repeat_words", counted).drop("__words", "__hashes", "__sorted", "__places")


def measures() -> dict[str, Column]:
    """What is sketched: the measures with adaptive thresholds."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"n_words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "__n_lines"), "repeat_share": per("n_repeat_words", "n_words")}


def bucket(value: Column) -> Column:
    """The sketch bucket of a value; -1e6 holds all below LEAST."""
    return F.when(value < LEAST, -1_000_000).otherwise(F.ceil(F.log(value) / math.log(GAMMA))).cast("int")


def sketches(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches (lang, source, measure, bucket, n) of the documents with enough words."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures().items())))
    rows = counts.filter(F.col("n_words") >= LEAST_WORDS).select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) with a lower and an upper fence of every measure, named __{measure}_low and _high."""
    # a level's sketch is the sum of those below it: level 0 a source, 1 a language, 2 all
    keys = sketch.select("lang", "source").distinct()
    wide = lambda level, *by: sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n")).withColumns({k: F.lit(None).cast("string") for k in ("lang", "source") if k not in by}).withColumn("level", F.lit(level))
    levels = sketch.withColumn("level", F.lit(0)).unionByName(wide(1, "lang")).unionByName(wide(2))
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = levels.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    value = F.when(F.col("bucket") == -1_000_000, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, value))
    ranks = {"q25": 0.25, "q75": 0.75, "q90": 0.9, "q99": 0.99}
    found = ranked.groupBy("level", "lang", "source", "measure").agg(*(at(q).alias(k) for k, q in ranks.items()), F.max("total").alias("total"))
    q1, q3 = F.col("q25") * (1 - ACCURACY), F.col("q75") * (1 + ACCURACY)
    low, high = F.lit(None).cast("double"), F.when(F.col("q99") > F.col("q90"), (F.col("q90") + TAIL * (F.col("q99") - F.col("q90"))) * (1 + ACCURACY))
    for k, width in WIDTHS.items():
        ratio = F.pow(q3 / q1, F.lit(width))
        down, up = (q1 / ratio, q3 * ratio) if k == "n_words" else (q1 - width * (q3 - q1), q3 + width * (q3 - q1))
        low, high = F.when(F.col("measure") == k, down).otherwise(low), F.when(F.col("measure") == k, up).otherwise(high)
    made = found.filter((F.col("total") >= ENOUGH) | (F.col("level") == 2)).withColumns({"low": low, "high": high}).filter("high IS NOT NULL")
    best = keys
    for level, by in ((0, ("lang", "source")), (1, ("lang",)), (2, ())):
        side = made.filter(F.col("level") == level).groupBy(*(F.col(k).alias(f"__{k}") for k in by)).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias(f"__f{level}"))
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
        best = best.join(side, on or F.lit(True), "left").drop(*(f"__{k}" for k in by))
    pick = lambda k: F.coalesce(*(F.col(f"__f{level}")[k] for level in range(3)))
    return best.select("lang", "source", *(pick(k)[side].alias(f"__{k}_{side}") for k in FENCED for side in ("low", "high")))


@apart
def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """Add the five measures, base_failed and kept to each row.

    base_failed: fewer than 50 words, or more than half of them in repeated three-word windows. kept: not
    base_failed, and every measure within the fences of the row's (lang, source). A null text counts as empty
    and fails. Null languages and sources form groups of their own. Equal rows get equal verdicts; extra
    columns are kept (the text unless ``keep_text`` is false), and columns with the names of the results are replaced;
    an empty table stays empty.

    The measures are taken once and written with the rows to the shared folder, for the sketches and the verdicts both;
    nothing but sketches is shuffled. The fences are a row for each source; they are broadcast only after they are counted.
    """
    df = df.drop(*(c for c in (*MEASURES, "base_failed", "kept") if c not in (text, lang, source)))
    counted = with_repeats(with_counts(df, text), text)
    counted = written(counted if keep_text else counted.drop(text))
    limits = checkpointed(fences(checkpointed(sketches(counted, lang, source))))
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    out = counted.join(limits, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.lit(True)
    for k in FENCED:
        v = measures()[k]  # a share has no lower fence
        inside &= F.coalesce(v >= F.col(f"__{k}_low"), F.lit(True)) & F.coalesce(v <= F.col(f"__{k}_high"), F.lit(True))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
    return out.drop("__lang", "__source", "__n_lines", *(f"__{k}_{side}" for k in FENCED for side in ("low", "high")))


@apart
def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that the rules keep, with their own columns.

    A column with the name of a measure is the row's own: it is set aside while the rules are applied.
    """
    clash = {c: f"__own_{c}" for c in df.columns if c in (*MEASURES, "base_failed", "kept")}
    own = df.withColumnsRenamed(clash)
    found = judge(own, text, lang, source).filter("kept").select(*own.columns)
    return found.withColumnsRenamed({v: k for k, v in clash.items()})
