"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> list[str]:
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text: str) -> list[str]:
    w = lowered(text)
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def components(docs: list[tuple[int, str]]) -> dict[int, int]:
    sets = {i: set(shingles(t)) for i, t in docs}
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def dedup(docs: list[tuple[int, str]], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> dict[int, set[int]]:
    """Items of which some window of the item's length has a similarity of 0.75 or more, all shingles weighing 1."""
    out = {}
    for i, t in docs:
        words, found = lowered(t), set()
        for item, body in items:
            n = len(lowered(body))
            want = Counter(shingles(body))
            for s in range(max(1, len(words) - n + 1)) if words and n else []:
                have = Counter(shingles(" ".join(words[s : s + n])))
                common = sum((have & want).values())
                if 100 * common >= 75 * (sum(have.values()) + sum(want.values()) - common):
                    found.add(item)
        out[i] = found
    return out


def weighted_leaks(docs: list[str], items: list[tuple[int, str]]) -> list[dict[int, tuple[int, float]]]:
    """For each text the leaked items with the first word and the similarity of the best window, shingles weighing by
    how few items hold them."""
    bags = [Counter(shingles(body)) for _, body in items]
    df = Counter(s for bag in bags for s in bag)
    weigh = lambda s: math.log1p(len(items) / df[s]) / math.log1p(len(items)) if s in df else 1.0
    out = []
    for text in docs:
        words, found = lowered(text), {}
        for (item, body), want in zip(items, bags):
            n = len(lowered(body))
            for s in range(max(1, len(words) - n + 1)):
                have = Counter(shingles(" ".join(words[s : s + n])))
                common = sum(c * weigh(x) for x, c in (have & want).items())
                score = round(common / (sum(c * weigh(x) for x, c in have.items()) + sum(c * weigh(x) for x, c in want.items()) - common), 9)
                if score >= 0.75 and (item not in found or (score, -s) > (found[item][1], -found[item][0])):
                    found[item] = (s, score)
        out.append(found)
    return out


def quality(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed
