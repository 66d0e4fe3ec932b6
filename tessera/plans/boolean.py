"""Boolean queries as column predicates: terms and phrases are substrings, case aside; NOT binds before AND before OR."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Query:
    text: str
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.left = [m.group(0) for m in re.finditer(r'"[^"]*"?|[()]|[^\s()"]+', self.text)]
        self.tree = self._any() if self.left else None

    def _next(self) -> str:
        return self.left[0] if self.left else ""

    def _any(self):
        parts = [self._all()]
        while self._next().upper() == "OR":
            self.left.pop(0)
            parts.append(self._all())
        return ("or", [p for p in parts if p])

    def _all(self):
        parts = []
        while self._next() not in ("", ")") and self._next().upper() != "OR":
            if self._next().upper() == "AND":
                self.left.pop(0)
            else:
                parts.append(self._one())
        return ("and", [p for p in parts if p])

    def _one(self):
        token = self.left.pop(0)
        if token.upper() == "NOT":
            return ("not", [self._one()]) if self._next() not in ("", ")") else None
        if token == "(":
            inner = self._any()
            if self._next() == ")":
                self.left.pop(0)
            return inner
        if token == ")":
            return None
        if token.startswith('"'):
            self.phrases.append(token.strip('"'))
            return ("has", self.phrases[-1])
        self.terms.append(token)
        return ("has", token)


def boolean_match(text: Column, query: str) -> Column:
    """Whether a text satisfies the query; an empty query fits nothing."""
    low = F.lower(text)

    def built(node) -> Column:
        kind, inside = node
        if kind == "has":
            return F.contains(low, F.lit(inside.lower()))
        if kind == "not":
            return ~built(inside[0])
        return reduce(lambda a, b: a & b if kind == "and" else a | b, map(built, inside)) if inside else F.lit(False)

    tree = Query(query).tree
    return built(tree) if tree else F.lit(False)


def highlight_regex(query: str) -> str:
    """What is marked in a text: terms between word borders, phrases anywhere."""
    q = Query(query)
    parts = [rf"\b{re.escape(t)}\b" for t in q.terms if t] + [re.escape(p) for p in q.phrases if p]
    return "(?i)" + "|".join(parts) if parts else r"(?!)"


def highlight(text: Column, query: str, before: str = "**", after: str = "**") -> Column:
    return F.regexp_replace(text, F.lit(f"({highlight_regex(query)})"), F.lit(f"{re.escape(before)}$1{re.escape(after)}"))


def highlights(text: Column, query: str) -> Column:
    """All marked strings, in order."""
    return F.regexp_extract_all(text, F.lit(highlight_regex(query)), F.lit(0))


#: What tells a boolean query from a regular expression.
BOOLEAN = r'(?i)(?:^|[\s()"])(?:and|or|not)(?=$|[\s()"])|["(]'
REGEX = r"[.*+?^${}()|\[\]\\]"


def route(query: Column, mode: Column, keyword: Column, recommended: str = "keyword") -> Column:
    """The mode of a query: what it asks for, else its flag, its syntax, or the recommended mode."""
    return F.when(mode.isNotNull(), mode).when(keyword, "keyword").when(query.rlike(BOOLEAN), "keyword").when(query.rlike(REGEX), "keyword").otherwise(recommended)
