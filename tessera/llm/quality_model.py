"""Quality: naive Bayes support vectors.

Indicators of case-sensitive character n-grams are scaled by class log-count ratios (Wang and Manning, "Baselines and
bigrams", 2012), each text's vector is brought to length 1, and a linear model with hinge loss is fitted by dual
coordinate descent (Hsieh et al., 2008). A logistic curve through margins of rows apart makes them probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear_ngrams as ln

ORDERS, COST, PASSES, THRESHOLD = (1, 4), 10.0, 30, 0.3
#: One in so many rows is kept from fitting, for the logistic curve.
APART = 5
#: Rows whose crc32(id) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 5, 0


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, n_features: int, passes: int = PASSES) -> np.ndarray:
    """Hinge-loss weights; each row is (features, values), the last weight belongs to a constant feature 1."""
    w, alpha = np.zeros(n_features + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(rows)):
            feature, value = rows[i]
            gradient = sign[i] * (w[feature] @ value + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (change := (new - alpha[i]) * sign[i]) != 0:
                w[feature] += change * value
                w[-1] += change
                alpha[i] = new
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return w


def train(features: list[np.ndarray], labels: np.ndarray, aside: np.ndarray, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float, float, float]:
    """Fit on the rows that aren't aside, calibrate on the others (or on all) with the classes' shares in all labelled rows."""
    rows = []
    for f in features:
        value = ratio[f]
        rows.append((f, value / max(1e-9, np.sqrt(value @ value))))
    own = np.flatnonzero(~aside)
    w = dual_descent([rows[i] for i in own], 2.0 * labels[own] - 1, np.full(len(own), COST), len(ratio))
    test = np.flatnonzero(aside) if aside.any() else own
    margin = np.array([w[rows[i][0]] @ rows[i][1] + w[-1] for i in test])
    share = labels[test].mean()
    weight = np.where(labels[test] == 1, prior / share, (1 - prior) / (1 - share))
    return w[:-1], float(w[-1]), *ln.calibrate(margin, labels[test], weight)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Add held_out, score and predicted to every row of ``docs``.

    The model learns from at most ln.SAMPLE_ROWS rows of each class that aren't held out. Null and empty texts
    have no n-grams and get the score of the bias. Repeated rows get equal scores; extra columns are kept, and
    columns with the names of the results are replaced. With labels of one class, every score is that class's
    smoothed share; without any label it is an error, but an empty table of documents gives an empty one.
    """
    rows = ln.sample(docs, labels, label, ~ln.held_out(id_col, FOLDS, HELD_OUT), id_col, text)
    scored = ln.with_score(docs, ln.fit(rows, train, ORDERS, False, True, APART), text, threshold)
    return scored.withColumn("held_out", F.coalesce(ln.held_out(id_col, FOLDS, HELD_OUT), F.lit(False)))
