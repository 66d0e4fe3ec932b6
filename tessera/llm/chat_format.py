"""Chat formatting: a hidden Markov model recovers the speakers of a transcript, then turns are rendered alike.

States are (role, first line of a turn or a later one). A line shows a speaker marker (or none), its length, whether
it ends in a question mark, and whether it is the first of its record. Probabilities are counts over labelled
conversations, smoothed by one; Viterbi's path through all lines of a conversation gives the roles.

Rows are range-partitioned by (conversation, turn, text), so a conversation of any length spreads over tasks. A task
knows its stretch of a conversation as a max-plus matrix from entry to exit states; the matrices of those few stretches
that meet at task borders are chained, and each task then finds its own path between the states agreed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

ROLES = ("system", "user", "assistant")
#: Names by which transcripts call the roles.
NAMES = {"system": ("system", "sys", "instructions", "context"), "user": ("user", "human", "question", "customer", "q"), "assistant": ("assistant", "ai", "bot", "answer", "model", "agent", "a")}
MARKER = re.compile(r"\s{0,3}(?:#{1,6}\s*|\*\*|\[|<\|?|>\s*)?(" + "|".join(sorted((n for v in NAMES.values() for n in v), key=len, reverse=True)) + r")\s*(?:\|?>|\]:?|:\*\*|\*\*:|:)\s*", re.IGNORECASE)
_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
N, LENGTHS = 2 * len(ROLES), (1, 40, 80, 160, 320)
#: Values of each feature: marker (none or a role), length, question mark, first of its record and after a blank line.
SIZES = (1 + len(ROLES), len(LENGTHS) + 1, 2, 4)
_EMIT = N * sum(SIZES)


def marker(line: str) -> tuple[int, str]:
    """0 and the line, or 1 + the role whose marker opens it and what follows the marker."""
    m = MARKER.match(line)
    return (1 + _ROLE_OF[m[1].lower()], line[m.end() :]) if m else (0, line)


def features(text: str) -> tuple[list[tuple[int, ...]], list[str]]:
    """The features of each line of a record, and the lines without their markers."""
    seen, bare, blank = [], [], 0
    for i, line in enumerate(text.split("\n")):
        who, rest = marker(line)
        seen.append((who, int(np.searchsorted(LENGTHS, len(rest), side="right")), int(rest.rstrip().endswith("?")), 2 * (i == 0) + blank))
        bare.append(rest)
        blank = int(not line.strip())
    return seen, bare


def learn(rows: DataFrame, conv: str, turn: str, text: str, role: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities (start, transition, emission by feature value) counted over all labelled ``rows``."""
    known = rows.filter(F.col(role).isin(*ROLES)).select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("x"), F.col(role).alias("r"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_EMIT + N * N)
        for batch in batches:
            for body, r in zip(batch["x"], batch["r"]):
                state = 2 * ROLES.index(r)
                seen, _ = features(body)
                for i, values in enumerate(seen):
                    s, base = state + (i > 0), 0
                    for v, size in zip(values, SIZES):
                        total[N * base + s * size + v] += 1
                        base += size
                    if i:
                        total[_EMIT + N * (state + (i > 1)) + s] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "n": total[at]})

    # how turns follow each other: pairs of neighbours, joined on the number of the turn
    turns = known.groupBy("c", "t").agg(F.min("r").alias("r"), F.min(F.contains("x", F.lit("\n"))).alias("many"))
    after = turns.select("c", (F.col("t") - 1).alias("t"), F.col("r").alias("r2"))
    pairs = {(r["r"], r["r2"], r["many"]): r["n"] for r in turns.join(after, ["c", "t"]).groupBy("r", "r2", "many").agg(F.count("*").alias("n")).collect()}
    firsts = {r["r"]: r["n"] for r in turns.filter("t = 0").groupBy("r").agg(F.count("*").alias("n")).collect()}
    counts = np.ones(_EMIT + N * N)
    for r in known.mapInPandas(counted, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] += r["n"]
    for (a, b, many), n in pairs.items():
        counts[_EMIT + N * (2 * ROLES.index(a) + bool(many)) + 2 * ROLES.index(b)] += n
    step = counts[_EMIT:].reshape(N, N)
    for role_a in range(len(ROLES)):  # a later line is of the turn it stands in
        for role_b in range(len(ROLES)):
            if role_a != role_b:
                step[2 * role_a : 2 * role_a + 2, 2 * role_b + 1] = 1e-9
    emit, base = [], 0
    for size in SIZES:
        part = counts[N * base : N * (base + size)].reshape(N, size)
        emit.append(np.log(part / part.sum(1, keepdims=True)))
        base += size
    start = np.array([firsts.get(r, 0) + 1 if inside == 0 else 1e-9 for r in ROLES for inside in (0, 1)])
    return np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), np.concatenate([e.T for e in emit])


class Decoder:
    """Scores lines and finds paths."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit
        self.base = np.cumsum((0, *SIZES[:-1]))

    def scores(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        return self.emit[np.array(seen) + self.base].sum(axis=1)

    def matrix(self, scores: np.ndarray) -> np.ndarray:
        """Best score from each state before the stretch (last row: a conversation begins) to each state at its end."""
        best = np.vstack((self.step, self.start)) + scores[0]
        for line in scores[1:]:
            best = (best[:, :, None] + self.step[None]).max(1) + line
        return best

    def path(self, scores: np.ndarray, entry: int | None, leave: int | None) -> np.ndarray:
        """The best path, from the state before (None: a conversation begins) to the last state (None: any)."""
        best = (self.start if entry is None else self.step[entry]) + scores[0]
        back = np.zeros((len(scores), N), np.int8)
        for i, line in enumerate(scores[1:], 1):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(0)
            best = ways.max(0) + line
        out = np.zeros(len(scores), np.int64)
        out[-1] = int(best.argmax()) if leave is None else leave
        for i in range(len(scores) - 1, 0, -1):
            out[i - 1] = back[i][out[i]]
        return out


def rendered(lines: list[str], path: np.ndarray) -> str:
    """Canonical text: each turn under a header with its role; a marker's own line goes if nothing follows the marker."""
    out = []
    for i, (line, state) in enumerate(zip(lines, path.tolist())):
        if state % 2 == 0:
            out.append(f"<|{ROLES[state // 2]}|>")
            if not line.strip() and i + 1 < len(lines):
                continue
        out.append(line)
    return "\n".join(out)


def parse(df: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], conv: str = "conv_id", turn: str = "turn", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Recover the roles of transcripts: one row per distinct (conv, turn, text) with role, n_turns and rendered.

    A conversation's lines are those of its rows in order of (turn, text); null turns come first, a null text is an
    empty line, and rows with a null conversation are one conversation. Rows that repeat wholly count once. role is
    that of the row's first line, n_turns the turns that begin in it, rendered the canonical text of its lines.
    Only these columns are returned. An empty table gives an empty one.
    """
    session = df.sparkSession
    n = partitions or max(2, int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("x")).distinct()
    order = ["c", "t", "x"]
    rows = checkpointed(rows.repartitionByRange(n, "c", "t", F.xxhash64("x")).sortWithinPartitions("c", "t", F.xxhash64("x"), "x").withColumn("p", F.spark_partition_id()))
    shared = session.sparkContext.broadcast(model)
    kinds = {k: rows.schema[k].dataType.simpleString() for k in order}

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each task's rows, cut where the conversation changes."""
        own, last = [], None
        for batch in batches:
            key = batch["c"].astype(object).where(batch["c"].notna(), None)
            cut = np.flatnonzero((key != key.shift()) & ~(key.isna() & key.shift().isna()))
            edges = sorted({0, *cut.tolist(), len(batch)})
            for a, b in zip(edges, edges[1:]):
                if own and key.iloc[a] != last:
                    yield pd.concat(own)
                    own = []
                own.append(batch.iloc[a:b])
                last = key.iloc[a]
        if own:
            yield pd.concat(own)

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, first, latest = Decoder(*shared.value), None, None
        matrix = lambda s: pd.DataFrame({"c": s["c"].iloc[:1], "p": s["p"].iloc[:1], "m": [decoder.matrix(np.concatenate([decoder.scores(features(x)[0]) for x in s["x"]])).ravel()]})
        for s in stretches(batches):
            if first is None:
                first = s
                yield matrix(s)
            else:
                latest = s
        if latest is not None:
            yield matrix(latest)

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit states of a conversation's stretches."""
        pdf = pdf.sort_values("p")
        first, *others = (np.asarray(m).reshape(N + 1, N) for m in pdf["m"])
        best, back = first[N], []
        for m in others:
            ways = best[:, None] + m[:N]
            back.append(ways.argmax(0))
            best = ways.max(0)
        leave = [int(best.argmax())]
        for b in reversed(back):
            leave.append(int(b[leave[-1]]))
        leave.reverse()
        return pd.DataFrame({"c": pdf["c"], "p": pdf["p"], "entry": [-1, *leave[:-1]], "leave": leave})

    found = rows.mapInPandas(borders, f"c {kinds['c']}, p int, m array<double>")
    many = found.groupBy("c").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("c").alias("c2"))
    meeting = found.join(F.broadcast(many), F.col("c").eqNullSafe(F.col("c2"))).drop("c2")
    # at most two stretches of a task are known at its borders: the broadcast is bounded by the number of tasks
    agreed = meeting.groupBy("c").applyInPandas(chained, f"c {kinds['c']}, p int, entry int, leave int")
    known = session.sparkContext.broadcast({(r["c"], r["p"]): (r["entry"], r["leave"]) for r in agreed.collect()})

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(*shared.value)
        for s in stretches(batches):
            lines = [features(x) for x in s["x"]]
            key = s["c"].iloc[0]
            entry, leave = known.value.get((None if pd.isna(key) else key, s["p"].iloc[0]), (-1, None))
            path = decoder.path(np.concatenate([decoder.scores(seen) for seen, _ in lines]), None if entry < 0 else entry, leave)
            ends = np.cumsum([len(bare) for _, bare in lines])
            parts = np.split(path, ends[:-1])
            yield pd.DataFrame({"c": s["c"], "t": s["t"], "role": [ROLES[p[0] // 2] for p in parts], "n_turns": [int((p % 2 == 0).sum()) for p in parts], "rendered": [rendered(bare, p) for (_, bare), p in zip(lines, parts)]})

    out = rows.mapInPandas(decoded, f"c {kinds['c']}, t {kinds['t']}, role string, n_turns long, rendered string")
    return out.select(F.col("c").alias(conv), F.col("t").alias(turn), "role", "n_turns", "rendered")


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw records as chat logs have them: a speaker marker in one of five styles, which one record in eight lacks."""
    style, bare = F.pmod(F.xxhash64("conv_id"), F.lit(5)), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    name = F.initcap("role")
    heads = [F.concat(name, F.lit(": ")), F.concat(F.lit("### "), name, F.lit(":\n")), F.concat(F.lit("["), F.col("role"), F.lit("] ")), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")), F.when(F.col("role") == "user", "Q: ").when(F.col("role") == "assistant", "A: ").otherwise("System: ")]
    head = heads[-1]
    for k, h in enumerate(heads[:-1]):
        head = F.when(style == k, h).otherwise(head)
    return conversations.withColumn("text", F.concat(F.when(bare | F.col("role").isNull(), "").otherwise(head), F.coalesce("text", F.lit(""))))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Learn from the labelled conversations whose hash isn't divisible by four, parse all of them as raw transcripts."""
    raw = transcripts(conversations)
    model = learn(raw.filter(F.pmod(F.xxhash64("conv_id"), F.lit(4)) != 0), "conv_id", "turn", "text", "role")
    return parse(raw, model)
