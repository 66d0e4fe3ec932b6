"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks.

Rules are ``(action, pattern)`` with action ``allow`` or ``block`` and pattern ``host/path``. A rule
fits its host and all subdomains if the url's path starts with the rule's path. The longest fitting
rule decides: more host labels first, then the longer path; allow and block rules stand in the same trie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import apart

#: The rules of the production query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: A trie of more rules than this isn't broadcast; such lists go the way of a join.
MOST_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Node:
    """A place in the trie: where labels or segments lead, where the path begins, what rules end here."""

    __slots__ = ("kids", "path", "ends")

    def __init__(self):
        self.kids: dict[str, Node] = {}
        self.path: Node | None = None
        self.ends: dict[str, tuple[str, str]] = {}  # by what follows the pattern's last slash

    def kid(self, label: str) -> Node:
        return self.kids.setdefault(label, Node())


class RuleTrie:
    """Host labels from the right, then path segments from the left."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root = Node()
        for action, pattern in rules:
            host, slash, path = pattern.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.kid(label)
            rest = ""
            if slash:
                node.path = node = node.path or Node()
                *whole, rest = path.split("/")
                for segment in whole:
                    node = node.kid(segment)
            node.ends.setdefault(rest, (pattern, action))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as (pattern, action)."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            if not (node := node.kids.get(label)):
                break
            best = self._along(node, path) or best  # a longer host outranks any path of a shorter one
        return best

    @staticmethod
    def _along(node: Node, path: str) -> tuple[str, str] | None:
        best = node.ends.get("")
        if not path.startswith("/") or not (node := node.path):
            return best
        for segment in path[1:].split("/"):
            if fits := [rest for rest in node.ends if segment.startswith(rest)]:
                best = node.ends[max(fits, key=len)]
            if not (node := node.kids.get(segment)):
                break
        return best


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@apart
def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str]] = RULES, url: str = "url", default: str = "allow", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict (the rule's action, else ``default``).

    Null urls and those without ``://`` have an empty host and path and fit no rule. Where two rules
    have the same pattern, the first counts. Repeated rows are judged each; extra columns are kept, and
    columns with the names of the results are replaced. Lists of more than ``most_broadcast`` rules
    are joined instead of broadcast.
    """
    rules = list(dict.fromkeys(rules))
    if bad := [r for r in rules if r[0] not in ("allow", "block") or not r[1].partition("/")[0]]:
        raise ValueError(f"not a rule: {bad[0]}")
    out = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if len(rules) > most_broadcast:
        return _joined(out, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, action string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match, none = trie.value.match, (None, None)
        for hosts, paths in batches:
            yield pd.DataFrame([match(h, p) or none for h, p in zip(hosts, paths)], columns=["rule", "action"], dtype="object")

    found = F.col("__judged")
    return out.withColumn("__judged", judged("host", "path")).withColumns({"rule": found["rule"], "verdict": F.coalesce(found["action"], F.lit(default))}).drop("__judged")


def _joined(df: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """Long lists: each distinct (host, path) meets the rules of its host suffixes in an equi-join."""
    rows = [(p.partition("/")[0], p.partition("/")[1] + p.partition("/")[2], p, a, i) for i, (a, p) in enumerate(rules)]
    table = df.sparkSession.createDataFrame(rows, "suffix string, start string, rule string, action string, place long")
    places = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = places.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    fits = tails.join(table, "suffix").filter(F.startswith(F.col("path"), F.col("start")))
    rank = F.struct(F.length("suffix"), F.length("start"), -F.col("place"), F.col("rule"), F.col("action"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("__best"))
    return df.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumns({"rule": F.col("__best")["rule"], "verdict": F.coalesce(F.col("__best")["action"], F.lit(default))}).drop("__best")
