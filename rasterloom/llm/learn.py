"""Labelled rows for the classifiers, and logistic regression on a few columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from at most, about: beyond it, those are taken whose hashed ids are smallest.
TRAIN_ROWS = 20_000
STEPS = 1 << 20


def training_labels(labels: DataFrame, target: str, learnt, key: str = "doc_id", most: int = TRAIN_ROWS) -> DataFrame:
    """(key, label): one row for each labelled id that learnt (a Column) admits, about `most` of them by the ids' hashes.

    Null ids and null labels are left out; of contradictory labels the larger counts. The rows are few enough to broadcast.
    """
    own = labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull() & learnt)
    own = own.groupBy(F.col(key).alias("key")).agg(F.max(F.col(target).cast("int")).alias("label"))
    total = own.count()
    if total > most:
        own = own.filter(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(STEPS)) < int(STEPS * most / total))
    return own


def learnt_texts(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """(text, label), one row for each chosen (key, label) that docs has: of several texts under one key the least, so
    that repeated rows add nothing."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # TRAIN_ROWS ids
    return own.groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of the columns of x and, last, the intercept, by Newton's method with a small ridge."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * max(len(x), 1))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
