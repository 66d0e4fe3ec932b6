"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

N-grams are of the characters of lower-cased text. The indicator of each selected
n-gram is scaled by its log-count ratio (Wang and Manning, "Baselines and bigrams", 2012) and a ridge-penalized
logistic model is fitted by Newton's method with conjugate gradients.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear_ngrams as ln

ORDERS, RIDGE, THRESHOLD = (3, 6), 1.0, 0.3
#: Rows whose crc32(id) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 4, 2


def segments(ids: np.ndarray, size: int):
    """Sums of values by their ids, which are in order: a function of the values."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)

    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        if len(starts):
            out[ids[starts]] = np.add.reduceat(values, starts)
        return out

    return summed


def logistic(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, n_features: int, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias that minimize weighted log loss plus ridge; the bias bears no penalty. Rows are in order."""
    w, n = np.zeros(n_features + 1), len(label)
    by_feature = np.argsort(feature, kind="stable")
    row_of, value_of = row[by_feature], value[by_feature]
    row_sums, feature_sums = segments(row, n), segments(feature[by_feature], n_features)

    def times(v):
        return row_sums(value * v[feature]) + v[-1]

    def back(u):
        return np.append(feature_sums(value_of * u[row_of]), u.sum())

    penalty = np.append(np.full(n_features, ridge), 1e-6)
    loss = lambda v: float(weight @ np.logaddexp(0, -(2 * label - 1) * times(v)) + 0.5 * penalty @ v**2)
    for _ in range(40):
        p = ln.sigmoid(times(w))
        gradient = back(weight * (p - label)) + penalty * w
        if np.linalg.norm(gradient) < 1e-5 * n:
            break
        curve = weight * p * (1 - p)
        step, rest = np.zeros_like(w), -gradient
        towards, size = rest.copy(), rest @ rest
        for _ in range(60):
            bent = back(curve * times(towards)) + penalty * towards
            far = size / (towards @ bent)
            step += far * towards
            rest -= far * bent
            if (less := rest @ rest) < 1e-4 * (gradient @ gradient):  # Newton's steps needn't be exact
                break
            towards, size = rest + less / size * towards, less
        now, scale = loss(w), 1.0
        while loss(w + scale * step) > now + 1e-4 * scale * (gradient @ step) and scale > 1e-6:
            scale /= 2
        w = w + scale * step
    return w[:-1], float(w[-1])


def train(features: list[np.ndarray], labels: np.ndarray, aside: np.ndarray, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float, float, float]:
    """Fit on a sample; each class weighs as in all labelled rows, so that scores are probabilities."""
    feature = np.concatenate(features)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    w, bias = logistic(row, feature, ratio[feature], labels, len(ratio), weight)
    return w, bias, 1.0, 0.0


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Add held_out, score and predicted to every row of ``docs``.

    The model learns from at most ln.SAMPLE_ROWS rows of each class that aren't held out. Null and empty texts
    have no n-grams and get the model's base score. Repeated rows get equal scores; extra columns are kept, and
    columns with the names of the results are replaced. With labels of one class, every score is that class's
    smoothed share; without any label it is an error, but an empty table of documents gives an empty one.
    """
    rows = ln.sample(docs, labels, label, ~ln.held_out(id_col, FOLDS, HELD_OUT), id_col, text)
    scored = ln.with_score(docs, ln.fit(rows, train, ORDERS, True, False), text, threshold)
    return scored.withColumn("held_out", F.coalesce(ln.held_out(id_col, FOLDS, HELD_OUT), F.lit(False)))
