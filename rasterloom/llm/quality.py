"""Text quality by a sparse rule ensemble.

Statistics of whole texts are Spark columns. On a bounded sample of labelled rows many small trees are grown; every path
from a root is a rule, a conjunction of bounds on statistics. A logistic regression with a lasso penalty gives most rules the
weight 0; the rest are compiled back into one Spark column, so that scoring a corpus needs no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import beside, fold
from rasterloom.llm.learn import learnt_texts, training_labels

#: name, the characters or runs it counts in a text
MARKS = (
    ("letters_upper", r"\p{Lu}"),
    ("digits", r"[0-9]"),
    ("stops", r"[.,;:?]"),
    ("bangs", r"!"),
    ("symbols", r"[#$%&*@^~|<>{}\[\]\\/_=+]"),
    ("symbol_runs", r"[#$%&*@^~|<>{}\\/_=+]{3,}"),
)
NAMES = ("chars", "words", "word_length", "lines", "distinct", "repeats", *(f"{name}_share" for name, _ in MARKS))
TREES, DEPTH, CUTS = 60, 3, 24


def statistics(text: Column, prefix: str = "") -> list[Column]:
    """The columns of NAMES for a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    w = F.split(t, r"\s+")
    n, chars = F.size(w).cast("double"), F.length(t).cast("double")
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    values = [chars, n, chars / n, F.regexp_count(t, F.lit("\n")) + 1.0, F.size(F.array_distinct(w)) / n, F.aggregate(pairs, F.lit(0), lambda a, b: a + b) / n]
    values += [F.regexp_count(t, F.lit(p)) / (chars + 1.0) for _, p in MARKS]
    return [v.cast("double").alias(prefix + name) for v, name in zip(values, NAMES, strict=True)]


Bound = tuple[int, bool, float]  # statistic, whether above, cut


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Bound, ...], ...]
    weights: tuple[float, ...]
    intercept: float


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], draw, depth: int, path: tuple, out: set) -> None:
    """Split by the largest fall in squared error over half of the statistics; every node's path is a rule."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return
    best = (1e-9, None)
    for j in draw.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        above = x[:, j][:, None] > cuts[j][None, :]
        n, s = above.sum(axis=0), y @ above
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n >= 5) & (len(y) - n >= 5), s**2 / n + (y.sum() - s) ** 2 / (len(y) - n), -np.inf) - y.sum() ** 2 / len(y)
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), (j, float(cuts[j][gain.argmax()])))
    if best[1] is None:
        return
    j, cut = best[1]
    for above in (False, True):
        own = (x[:, j] > cut) == above
        grow(x[own], y[own], cuts, draw, depth - 1, (*path, (int(j), above, cut)), out)


def holds(rule: tuple[Bound, ...], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) == above for j, above, cut in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute penalty on the weights, by accelerated proximal steps."""
    n = len(y)
    wide = np.c_[z, np.ones(n)]
    rate = 4 * n / max(np.linalg.norm(wide.T @ wide, 2), 1e-9)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        step = v - rate * (z.T @ (p - y)) / n
        w2, b2 = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), c - rate * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, penalty: float = 5e-4) -> Model:
    """Rules from trees on random halves, and their lasso weights."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model((), (), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    found: set = set()
    for _ in range(TREES):
        own = draw.choice(len(y), size=max(1, min(len(y), max(len(y) // 2, 50))), replace=False)
        grow(x[own], y[own].astype(float), cuts, draw, int(draw.integers(1, DEPTH + 1)), (), found)
    rules = sorted(found)
    z = np.array([holds(r, x) for r in rules]).T if rules else np.empty((len(y), 0), bool)
    first = {c.tobytes(): i for i, c in reversed(list(enumerate(z.T)))}  # rules that hold for the same texts are one
    keep = sorted(first.values())
    rules, z = [rules[i] for i in keep], z[:, keep].astype(float)
    w, b = lasso(z, y.astype(float), penalty)
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), b)


def train(docs: DataFrame, labels: DataFrame, learnt, key: str = "doc_id", text: str = "text", target: str = "quality") -> Model:
    """Learn from the labelled documents that `learnt` (a Column over labels) admits, a bounded sample of them."""
    chosen = training_labels(labels, target, learnt, key)
    own = learnt_texts(docs, chosen, key, text)
    rows = own.select(*statistics(F.col("text")), "label").toPandas()  # TRAIN_ROWS rows, about, of a few numbers
    order = rows.sort_values(list(rows.columns), kind="stable")  # the same model however the rows were dealt out
    return fit(order[list(NAMES)].to_numpy(), (order["label"].to_numpy() > 0).astype(int))


def compiled(model: Model, prefix: str) -> Column:
    """The model's probability as a column over the statistics' columns."""

    def bound(j: int, above: bool, cut: float) -> Column:
        c = F.col(prefix + NAMES[j])
        return c > cut if above else c <= cut

    parts = [F.when(reduce(lambda a, b: a & b, (bound(*x) for x in rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in zip(model.rules, model.weights, strict=True)]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(model.intercept))))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs with quality_score (0 to 1, higher is better).

    Null and empty texts get the score of an empty text; long texts are measured whole. Null ids, ties and repeated rows pass
    through; a column named quality_score, in any case, is replaced, all others stay. An empty table gives an empty result.
    """
    prefix = "_statistic_"
    own, t, back = beside(docs, text, "quality_score")
    return own.select("*", *statistics(F.col(t), prefix)).select(*back, compiled(model, prefix).alias("quality_score"))


def learnt(key: str = "doc_id"):
    """The labels that may be learnt: crc32 of the id as text, modulo 3, is not 1."""
    return fold(F.col(key), 3) != 1
