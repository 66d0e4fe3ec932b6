"""What the two text classifiers share: character n-gram indicators, class log-count ratios, scoring of whole texts.

N-grams are of code points, hashed to ``1 << BITS`` buckets. A model is learnt from a bounded sample of labelled rows with
whole texts of any length: tasks count the buckets of each class, ranges of buckets are added up and those that tell the
classes apart selected, tasks look up what each text has of them, and one task fits the weights to these short rows. A
model (a bias, the weights of the selected buckets, two calibration numbers) is broadcast; the buckets bound its size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written

#: Buckets of the hashed n-grams, and the characters that are worked on at once: longer texts are parted.
BITS, CHUNK = 20, 1 << 20
#: Bound of the sample that a model is fitted on: rows of each class. And the tasks that read it.
SAMPLE_ROWS, TASKS = 4000, 32
#: An n-gram is selected if its log-count ratio is so many standard errors from 0.
STANDARD_ERRORS = 4.0
#: Buckets are added up in so many ranges.
RANGES = 16


@dataclass
class Model:
    buckets: np.ndarray  # selected buckets in order
    weights: np.ndarray  # of each: log-count ratio times fitted weight
    bias: float
    slope: float
    shift: float
    orders: tuple[int, int]
    lower: bool
    unit: bool  # whether a text's vector is scaled to length 1
    ratios: np.ndarray  # log-count ratio of each selected bucket


def gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each character."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = data[:m].copy()
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h += data[k : k + m]
    h += np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BITS)


def code_points(text: str, lower: bool) -> np.ndarray:
    return np.frombuffer((text.lower() if lower else text).encode("utf-32-le", "surrogatepass"), np.uint32)


def places(buckets: np.ndarray) -> np.ndarray:
    """Of each bucket its place among the selected ones, or -1."""
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    return place


class Indicators:
    """The distinct features of texts: their buckets, or with ``place`` the places of selected buckets."""

    def __init__(self, orders: tuple[int, int], lower: bool, place: np.ndarray | None = None):
        self.orders, self.lower, self.place = orders, lower, place
        self.seen = np.zeros(1 << BITS, np.int64)

    def _distinct(self, found: np.ndarray) -> np.ndarray:
        at = np.arange(len(found))
        self.seen[found] = at  # the last of equal ones stays
        return found[self.seen[found] == at]

    def _together(self, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
        data = np.concatenate(texts) if len(texts) > 1 else texts[0]
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        parts = []
        for n in range(self.orders[0], self.orders[1] + 1):
            b = gram_buckets(data, n)
            f = b.astype(np.int32) if self.place is None else self.place[b]
            over = (starts[1:, None] - np.arange(1, n)).ravel()  # these n-grams end in another text
            f[over[(over >= 0) & (over < len(f))]] = -1
            at = np.flatnonzero(f >= 0)
            parts.append((f[at], np.searchsorted(at, starts)))
        for k in range(len(texts)):
            yield self._distinct(np.concatenate([f[edge[k] : edge[k + 1]] for f, edge in parts]))

    def __call__(self, texts) -> Iterator[np.ndarray]:
        waiting, size = [], 0
        for text in texts:
            data = code_points(text, self.lower)
            if size + len(data) > CHUNK and waiting:
                yield from self._together(waiting)
                waiting, size = [], 0
            if len(data) > CHUNK:
                step = [data[a : a + CHUNK + self.orders[1] - 1] for a in range(0, len(data), CHUNK)]
                yield self._distinct(np.concatenate([f for piece in step for f in self._together([piece])]))
                continue
            waiting.append(data)
            size += len(data)
        if waiting:
            yield from self._together(waiting)


def log_ratios(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each bucket, and whether it tells the classes apart; counts are texts of class 0 and 1 with it."""
    share = (counts + 0.5) / (n + 1)[:, None]
    error = np.sqrt(1 / (counts + 0.5) - 1 / (n + 1)[:, None]).clip(1e-3)
    ratio = np.log(share[1] / share[0])
    return ratio, np.abs(ratio) > STANDARD_ERRORS * np.hypot(*error)


def select(rows: DataFrame, orders: tuple[int, int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The selected buckets in order and their log-count ratios, from rows (text, label)."""
    width = (1 << BITS) // RANGES

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n, indicators = np.zeros((2, 1 << BITS), np.int32), [0, 0], Indicators(orders, lower)
        for batch in batches:
            for label, found in zip(batch["label"], indicators(batch["text"])):
                counts[label, found] += 1
                n[label] += 1
        if sum(n):
            yield pd.DataFrame([(k, *n, counts[:, k * width : (k + 1) * width].tobytes()) for k in range(RANGES)], columns=["k", "n0", "n1", "counts"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, np.int32).reshape(2, width).astype(np.int64) for c in pdf["counts"])
        ratio, apart = log_ratios(counts, pdf[["n0", "n1"]].sum().to_numpy(np.int64))
        at = np.flatnonzero(apart)
        return pd.DataFrame({"bucket": at + int(pdf["k"].iloc[0]) * width, "ratio": ratio[at]})

    told = rows.select("text", "label").mapInPandas(counted, "k int, n0 long, n1 long, counts binary").groupBy("k").applyInPandas(added, "bucket long, ratio double")
    found = told.toPandas().sort_values("bucket")  # as many as there are buckets at most
    return found["bucket"].to_numpy(np.int64), found["ratio"].to_numpy(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins (Platt scaling), by Newton's steps with a small ridge."""
    x, beta = np.stack((margin, np.ones(len(margin))), 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (p - label)) + 1e-2 * (beta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, id_col: str, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids of each class (those of smallest hash): (__id, text, label, prior).

    ``prior`` is the class's share of all learnable labels. Ids with two different labels aren't used.
    """
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias("label"), F.max(label).alias("top")).filter((F.col("label") == F.col("top")) & learnable)
    prior = ids.agg(F.avg("label").alias("prior"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    some = [ids.filter(F.col("label") == c).orderBy(order, id_col).limit(rows) for c in (0, 1)]
    chosen = some[0].union(some[1]).crossJoin(F.broadcast(prior)).select(F.col(id_col).alias("__id"), F.col("label").cast("int").alias("label"), "prior")
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most 2 * rows ids are broadcast; of repeated ids one text is used
    return texts.join(F.broadcast(chosen), "__id").groupBy("__id", "label", "prior").agg(F.min("text").alias("text"))


Trainer = Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, float], tuple[np.ndarray, float, float, float]]


def fit(rows: DataFrame, trainer: Trainer, orders: tuple[int, int], lower: bool, unit: bool, apart: int = 0) -> Model | None:
    """Learn from a sample; none if it is empty. Of the ids one in ``apart`` is kept from fitting, for calibration (0: none).

    ``trainer`` gets each row's selected features, the labels, which rows are kept apart, the features' ratios and the
    prior, and returns weights, bias, slope and shift. It runs in one task, over features of the bounded sample.
    """
    aside = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(5)), F.lit(apart)) == 0 if apart else F.lit(False)
    rows = written(rows.withColumn("aside", aside).repartition(TASKS, "__id"))
    sizes = {(r["label"], r["aside"]): r["n"] for r in rows.groupBy("label", "aside").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (label, _), n in sizes.items() if label == c) for c in (0, 1)]
    if not sum(total):
        discard(rows)
        return None
    if not all(total):  # one class alone: its smoothed share for every text
        discard(rows)
        share, none = (total[1] + 1) / (sum(total) + 2), np.zeros(0)
        return Model(none.astype(np.int64), none, float(np.log(share / (1 - share))), 1.0, 0.0, orders, lower, False, none)
    if not all(sizes.get((c, side)) for c in (0, 1) for side in (True, False)):
        apart = 0  # too few rows to set some apart
    own = rows.withColumn("aside", F.col("aside") & F.lit(apart > 0))
    buckets, ratios = select(own.filter("NOT aside"), orders, lower)
    shared = rows.sparkSession.sparkContext.broadcast(buckets)

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indicators = Indicators(orders, lower, places(shared.value))
        for batch in batches:
            yield pd.DataFrame({"id": batch["__id"], "label": batch["label"], "aside": batch["aside"], "prior": batch["prior"], "features": [np.sort(f).astype(np.int32).tobytes() for f in indicators(batch["text"])]})

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        w = trainer([np.frombuffer(f, np.int32) for f in pdf["features"]], pdf["label"].to_numpy(np.int64), pdf["aside"].to_numpy(bool), ratios, float(pdf["prior"].iloc[0]))
        return pd.DataFrame({"model": [pickle.dumps(w)]})

    kind = rows.schema["__id"].dataType.simpleString()
    short = own.mapInPandas(looked_up, f"id {kind}, label int, aside boolean, prior double, features binary")
    weights, bias, slope, shift = pickle.loads(short.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fitted, "model binary").first()["model"])
    discard(rows)
    return Model(buckets, weights * ratios, bias, slope, shift, orders, lower, unit, ratios)


def with_score(df: DataFrame, model: Model | None, text: str, threshold: float) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= threshold) of every whole text. Without a model, a table of any
    row is an error; an empty one stays empty."""
    if model is None:
        if not df.isEmpty():
            raise ValueError("no labelled row can be learnt from")
        return df.drop("score", "predicted").withColumns({"score": F.lit(None).cast("double"), "predicted": F.lit(None).cast("int")})
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        indicators, square = Indicators(m.orders, m.lower, places(m.buckets)), m.ratios**2
        for series in batches:
            margin = [m.weights[f].sum() / (max(1e-9, np.sqrt(square[f].sum())) if m.unit else 1.0) for f in indicators(series)]
            yield pd.Series(sigmoid(m.slope * (np.array(margin, np.float64) + m.bias) + m.shift))

    out = df.drop("score", "predicted").withColumn("score", scored(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
