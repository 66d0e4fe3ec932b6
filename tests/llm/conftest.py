from __future__ import annotations

import random

import pytest

SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve wi zo kra sto plu".split()


def prose(rng: random.Random, words: int) -> str:
    out = []
    while len(out) < words:
        n = rng.randint(4, 12)
        out += [" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)) + rng.choice([".", ",", ".\n"])]
    return " ".join(" ".join(out).split(" ")[:words])


@pytest.fixture(scope="session")
def messy() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, ties, copies, near copies, shared passages, one long text, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 220)
    passage = prose(rng, 60)
    near = [" ".join("changed" if k == cut else w for k, w in enumerate(base.split(" "))) for cut in (3, 100, 180)]
    docs: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (5, "one two three"), (6, "One TWO three")]
    docs += [(10, base), (11, base), (12, near[0]), (13, near[1]), (14, near[2]), (15, base[: len(base) // 2])]
    docs += [(20 + k, prose(rng, 90) + " " + passage + " " + prose(rng, 50)) for k in range(6)]
    docs += [(30, "ß→é 日本語 " * 40), (31, "a" * 450), (32, "word " * 130), (33, prose(rng, 9000)), (34, "<|endoftext|> x <|endoftext|>\x00 y")]
    docs += [(40 + k, prose(rng, 150)) for k in range(25)]
    return docs


@pytest.fixture(scope="session")
def messy_df(spark, messy):
    """The same with extra columns whose names clash with results."""
    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "mine", 7, None) for i, t in messy]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host string, n_words int, kept boolean")
