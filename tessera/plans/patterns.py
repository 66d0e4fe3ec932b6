"""Globs, ignore rules and user regular expressions, compiled on the driver to column predicates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as syntax

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest pattern taken, and what is ignored by default.
MOST_REGEX = 200
IGNORED = ("node_modules", ".git", "dist", "build")


def _compiled(glob: str, star: str, question: str, double: str | None = None) -> str:
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        if part == "**":
            out += double if double is not None else star * 2
        else:
            out += {"*": star, "?": question}.get(part) or re.escape(part)
    return out


def path_regex(glob: str) -> str:
    """``**`` is anything, ``*`` anything but slashes, ``?`` one character but a slash; the whole path, case aside."""
    return f"(?is)^{_compiled(glob, '[^/]*', '[^/]', '.*')}$"


def heading_regex(glob: str) -> str:
    """``*`` and ``?`` cross every character."""
    return f"(?is)^{_compiled(glob, '.*', '.')}$"


def path_matches(path: Column, glob: str) -> Column:
    return path.rlike(path_regex(glob))


#: Characters by which the beginnings of two branches are compared.
_SAMPLE = frozenset(map(chr, range(256))) | {"\u0416", "\u65e5"}
_KINDS = {sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D", sre.CATEGORY_SPACE: r"\s", sre.CATEGORY_NOT_SPACE: r"\S", sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W"}
_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT)


def _set(op, value) -> frozenset[str]:
    """Which characters of the sample one item of a pattern takes."""
    if op is sre.LITERAL:
        return frozenset({chr(value).lower()})
    if op is sre.NOT_LITERAL:
        return _SAMPLE - {chr(value)}
    if op is sre.RANGE:
        return frozenset(c.lower() for c in _SAMPLE if value[0] <= ord(c) <= value[1])
    if op is sre.CATEGORY:
        return frozenset(c for c in _SAMPLE if re.match(_KINDS[value], c)) if value in _KINDS else _SAMPLE
    if op is sre.IN:
        found = frozenset().union(*(_set(*item) for item in value if item[0] is not sre.NEGATE))
        return _SAMPLE - found if value[0][0] is sre.NEGATE else found
    return _SAMPLE


def _parts(op, value) -> list:
    """The sequences inside an item."""
    if op in _REPEATS or op is sre.POSSESSIVE_REPEAT:
        return [value[2]]
    if op is sre.SUBPATTERN:
        return [value[3]]
    if op is sre.BRANCH:
        return list(value[1])
    if op is sre.ATOMIC_GROUP:
        return [value]
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        return [value[1]]
    return [x for x in value[1:] if x is not None] if op is sre.GROUPREF_EXISTS else []


def _first(sequence) -> frozenset[str]:
    """The characters a sequence may begin with; one that may be empty begins with any."""
    found = frozenset()
    for op, value in sequence:
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        inner = _parts(op, value)
        found |= frozenset().union(*map(_first, inner)) if inner else _set(op, value)
        if not (op in _REPEATS and value[0] == 0):
            return found
    return _SAMPLE


def _ambiguous(sequence) -> bool:
    """Whether a text can be read in several ways: a repeat of variable length, or branches that begin alike."""
    for op, value in sequence:
        if op in _REPEATS and value[0] != value[1]:
            return True
        if op is sre.BRANCH and sum(map(len, firsts := [_first(b) for b in value[1]])) > len(frozenset().union(*firsts)):
            return True
        if any(map(_ambiguous, _parts(op, value))):
            return True
    return False


def _explodes(sequence) -> bool:
    """Whether what is ambiguous is itself repeated."""
    return any(op in _REPEATS and value[1] > 1 and _ambiguous(value[2]) or any(map(_explodes, _parts(op, value))) for op, value in sequence)


def check_regex(pattern: str) -> str:
    """The pattern, unless it is too long, invalid, or repeats what can be read in several ways, which may backtrack
    without end. It is judged by its syntax tree as Python reads it, so what Java alone knows (``\\p{Lu}``) is invalid here."""
    if len(pattern) > MOST_REGEX:
        raise ValueError(f"a pattern has at most {MOST_REGEX} characters, this one {len(pattern)}")
    try:
        tree = syntax.parse(pattern)
    except re.error as e:
        raise ValueError(f"not a pattern: {e}") from e
    if _explodes(tree):
        raise ValueError(f"the pattern may backtrack without end: {pattern}")
    return pattern


def judged_patterns(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add safe and reason (null if safe) to a table of patterns, by ``check_regex``; a null pattern isn't safe."""

    @F.pandas_udf("string")
    def wrong(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = []
            for p in series:
                try:
                    out.append(None if check_regex(p) == p else "")
                except ValueError as e:
                    out.append(str(e))
            yield pd.Series(out, dtype="object")

    reason = F.when(F.col(pattern).isNull(), "no pattern").otherwise(wrong(F.coalesce(pattern, F.lit(""))))
    return df.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull())


def ignore_regex(rule: str) -> tuple[str, bool, bool]:
    """Of one gitignore rule: the regular expression of the paths it names, whether it takes back (``!``), and whether it
    names folders alone."""
    back = rule.startswith("!")
    body = rule[back:].rstrip()
    inside = body.rstrip("/")
    anchored = "/" in inside
    out, rest = "", inside.lstrip("/")
    while rest:
        m = re.match(r"/\*\*/|^\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^]]*\]|\\.|.", rest)
        piece = m[0]
        rest = rest[len(piece) :]
        if piece == "/**/":
            out += "/(?:.*/)?"
        elif piece == "**/":
            out += "(?:.*/)?"
        elif piece == "/**":
            out += "/.*"
        elif piece in ("*", "**", "?"):
            out += {"*": "[^/]*", "**": ".*", "?": "[^/]"}[piece]
        elif piece.startswith("[") and len(piece) > 1:
            out += piece.replace("[!", "[^", 1)
        else:
            out += re.escape(piece[-1])
    return f"(?s)^{'' if anchored else '(?:.*/)?'}{out}$", back, body.endswith("/")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the path or a folder it is in is ignored: for each, the last rule that names it decides.

    What is below an ignored folder can't be taken back. Blank lines and comments aren't rules.
    """
    chain = [ignore_regex(r) for rule in rules if (r := rule.strip()) and not r.startswith("#")]
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))

    def named(p: Column) -> Column:
        verdict = F.lit(False)
        for pattern, back, folders in chain:
            fits = p.rlike(pattern) & (p != path) if folders else p.rlike(pattern)
            verdict = F.when(fits, F.lit(not back)).otherwise(verdict)
        return verdict

    return F.exists(above, named)
