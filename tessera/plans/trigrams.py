"""What a text must hold to satisfy a boolean query or a pattern, as a formula over three-letter strings.

A formula is None (any text may fit), a trigram, or ("and" | "or", formulas). It never rejects a text that fits; texts that
it lets through are verified. (After Cox, "Regular expression matching with a trigram index", 2012.)
"""

from __future__ import annotations

from functools import reduce
from re import _constants as sre
from re import _parser as syntax

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.boolean import Query
from tessera.plans.patterns import check_regex

Formula = str | tuple | None
#: Characters of a gram.
SIZE = 3


def all_of(parts: list[Formula]) -> Formula:
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def any_of(parts: list[Formula]) -> Formula:
    if not parts or None in parts:
        return None
    kept = list(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def of_string(text: str) -> Formula:
    """Texts that hold a string, case aside."""
    low = text.lower()
    return all_of([low[i : i + SIZE] for i in range(len(low) - SIZE + 1)])


def of_query(query: str) -> Formula:
    """Texts that may satisfy a boolean query."""

    def needed(node) -> Formula:
        kind, inside = node
        if kind == "has":
            return of_string(inside)
        if kind == "not":
            return None
        return (all_of if kind == "and" else any_of)([needed(n) for n in inside])

    tree = Query(query).tree
    return needed(tree) if tree else None


def of_pattern(pattern: str) -> Formula:
    """Texts in which a pattern may be found, case aside. Runs of ASCII letters that must follow each other are what is known."""
    return _Walk().over(syntax.parse(check_regex(pattern))).formula()


class _Walk:
    """Reads a sequence of a syntax tree: the string that is sure to stand here, and what was sure before it."""

    def __init__(self):
        self.run, self.parts = "", []

    def over(self, sequence) -> _Walk:
        for op, value in sequence:
            if op is sre.LITERAL and value < 128:
                self.run += chr(value)
            elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                pass  # of no width
            elif op is sre.SUBPATTERN:
                self.over(value[3])
            elif op is sre.ATOMIC_GROUP:
                self.over(value)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
                self.over(value[2])  # once, after what stands before; what follows the last time isn't known
                if value[1] != 1:
                    self.broken()
            else:
                self.broken()
                if op is sre.BRANCH:
                    self.parts.append(any_of([_Walk().over(b).formula() for b in value[1]]))
        return self

    def broken(self) -> None:
        self.parts.append(of_string(self.run))
        self.run = ""

    def formula(self) -> Formula:
        self.broken()
        return all_of(self.parts)


def grams(formula: Formula) -> list[str]:
    """The trigrams of a formula."""
    if formula is None:
        return []
    return [formula] if isinstance(formula, str) else sorted({g for part in formula[1] for g in grams(part)})


def holds(have: Column, formula: Formula) -> Column:
    """Whether an array of trigrams satisfies a formula."""
    if formula is None:
        return F.lit(True)
    if isinstance(formula, str):
        return F.array_contains(have, formula)
    kind, parts = formula
    return reduce(lambda a, b: a & b if kind == "and" else a | b, (holds(have, p) for p in parts))
