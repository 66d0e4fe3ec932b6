"""Fill-in-the-middle transformation: texts are cut at token borders that SWAR arithmetic finds eight bytes at a time.

A token is white space and the word after it; white space at a text's end is a token of its own. A token ends at a byte
of a word that white space or the text's end follows. The texts of a batch lie one after another as UTF-8, each filled up
with blanks to whole 64-bit words. Arithmetic on a word marks the high bit of each byte that ends a token, ``bitwise_count``
counts the marks, and running sums over the words make the k-th token's end a binary search followed by a selection of
the k-th mark inside one word (Vigna, "Broadword implementation of rank/select queries", 2008). No token is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart, unlike

#: The seed of the draws, the share in a hundred of texts that are transformed, and of those the share that puts the suffix first.
SEED, RATE, SPM = 42, 50, 80
#: The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
#: Texts are marked in pieces of so many bytes at least, so that a task's memory depends on its longest text alone.
PIECE_BYTES = 4 << 20

_EACH = lambda b: np.uint64(0x0101010101010101 * b)
_HIGH, _LOW7, _BLANK = _EACH(0x80), _EACH(0x7F), _EACH(0x20)
_FROM_TAB, _PAST_RETURN = _EACH(0x80 - 0x09), _EACH(0x80 - 0x0E)
_ONE, _TOP = np.uint64(1), np.uint64(56)


def spaces(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is one of \\x20, \\x09 to \\x0D; no carry leaves a byte, since seven bits are added to seven."""
    low = words & _LOW7
    blank = ~((low ^ _BLANK) + _LOW7)
    control = (low + _FROM_TAB) & ~(low + _PAST_RETURN)
    return (blank | control) & ~words & _HIGH


class Units:
    """The token ends of some texts."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        held = (self.sizes + 7) // 8
        self.first = np.concatenate(([0], np.cumsum(held)))  # a text's first word
        words = np.frombuffer(b"".join(t.ljust(8 * n, b" ") for t, n in zip(texts, held.tolist())), "<u8")
        blank = spaces(words)
        after = np.empty_like(blank)  # what stands behind the last byte of each word; behind a text it is its end
        after[:-1] = blank[1:] & np.uint64(0x80)
        after[self.first[1:][held > 0] - 1] = np.uint64(0x80)
        self.ends = ~blank & _HIGH & (blank >> np.uint64(8) | after << _TOP)
        if len(words):  # white space at the end of a text is a token
            some = np.flatnonzero(self.sizes)
            last = 8 * self.first[some] + self.sizes[some] - 1
            bit = np.uint64(0x80) << (8 * (last % 8)).astype(np.uint64)
            self.ends[last // 8] |= bit & blank[last // 8]
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))
        self.before = self.upto[self.first]
        self.n = np.diff(self.before)

    def end(self, k: np.ndarray) -> np.ndarray:
        """The bytes that the first ``k[i]`` tokens of text i take."""
        out = np.zeros(len(k), np.int64)
        some = np.flatnonzero(k)
        rank = self.before[:-1][some] + k[some]
        at = np.searchsorted(self.upto, rank) - 1
        marks, skip = self.ends[at], rank - self.upto[at] - 1
        for step in range(7):  # a word has eight marks at most: drop those before the one that is asked for
            more = skip > step
            marks[more] &= marks[more] - _ONE
        lowest = marks & (~marks + _ONE)
        out[some] = 8 * (at - self.first[some]) + np.bitwise_count(lowest - _ONE).astype(np.int64) // 8 + 1
        return out


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


@apart
def transform(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Add n (tokens), form, prefix_chars, middle_chars (code points; null if plain) and output to each row.

    Two draws by the row's id, modulo n + 1, part the tokens into prefix, middle and suffix. form is plain for an empty
    text, for one that contains a sentinel, and for all but ``rate`` in a hundred ids; else spm for ``spm`` in a hundred, else
    psm. output is the text (plain), ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm).

    A null text is empty; a null id draws as an empty id does. Equal rows get equal results. Other columns are kept, and
    columns with the names of the results are replaced; that ``id_col`` or ``text`` has such a name is an error. An empty
    table gives an empty one. Nothing is shuffled, and a text is cut whole however long it is.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    if {id_col, text} & set(made):
        raise ValueError(f"{id_col} and {text} can't have the name of a result: {', '.join(made)}")

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *drawn in batches:
            h1, h2, h3, h4 = (d.to_numpy(np.int64) for d in drawn)
            raw = [t.encode("utf-8") for t in texts]
            edges = _pieces(raw)
            yield pd.concat([_cut(texts.iloc[a:b], raw[a:b], h1[a:b], h2[a:b], h3[a:b] % 100 < rate, h4[a:b] % 100 < spm) for a, b in zip(edges, edges[1:])], ignore_index=True)

    own = unlike("__cut", *df.columns)
    out = df.drop(*made).withColumn(own, cut(F.coalesce(F.col(text), F.lit("")), *draws(F.col(id_col), seed)))
    return out.withColumns({k: F.col(own)[k] for k in made}).drop(own)


def _pieces(raw: list[bytes]) -> list[int]:
    """Where to part a batch, so that each part has few bytes or one text."""
    edges, held = [0], 0
    for i, t in enumerate(raw):
        if held and held + len(t) > PIECE_BYTES:
            edges.append(i)
            held = 0
        held += len(t)
    return [*edges, len(raw)]


def _cut(texts: pd.Series, raw: list[bytes], h1: np.ndarray, h2: np.ndarray, moved: np.ndarray, suffix_first: np.ndarray) -> pd.DataFrame:
    units = Units(raw)
    a, b = h1 % (units.n + 1), h2 % (units.n + 1)
    low, high = units.end(np.minimum(a, b)).tolist(), units.end(np.maximum(a, b)).tolist()
    rows = []
    for text, data, n, i, j, move, back in zip(texts, raw, units.n.tolist(), low, high, moved.tolist(), suffix_first.tolist()):
        if not move or not data or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            rows.append((n, "plain", None, None, text))
            continue
        prefix, middle, suffix = data[:i].decode(), data[i:j].decode(), data[j:].decode()
        form, output = ("spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}") if back else ("psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
        rows.append((n, form, len(prefix), len(middle), output))
    out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def restored(form: str = "form", output: str = "output") -> Column:
    """The text from a row's form and output alone; no part contains a sentinel, so each sentinel stands where it was put."""
    f, o = F.col(form), F.col(output)
    part = lambda c, sentinel, k: F.split_part(c, F.lit(sentinel), F.lit(k))
    head, middle = part(o, MIDDLE, 1), part(o, MIDDLE, 2)
    psm = F.concat(part(part(head, PREFIX, 2), SUFFIX, 1), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, part(part(head, SUFFIX, 2), PREFIX, 1))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)


def digest(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``transform``, with SHA-256 of the output and of the text rebuilt from it in place of the texts."""
    out = transform(df.select(id_col, text), id_col, text)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
