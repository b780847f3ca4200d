from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from rasterloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256.0):
    ok = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in ok]
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, u, strict=True)), j, m) for j, m, u in whole if j != i and len(u) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return Counter(out)


def vectors(draw, n, width, digits):
    return [[float(np.float32(x)) for x in np.round(v, digits)] for v in draw.normal(size=(n, width)) * 0.3 + 0.1]


@pytest.mark.parametrize("width, digits, labels", [(3, 1, 3), (16, 3, 2), (1, 0, 2)])  # rounded: many ties, and scores of zero
def test_equals_brute_force(spark, monkeypatch, width, digits, labels):
    for name, value in (("TILE_ANCHORS", 3), ("TILE_ROWS", 64), ("STRIPE_ROWS", 150), ("GROUP_BYTES", 16 * width + 400)):
        monkeypatch.setattr(hn, name, value)
    draw = np.random.default_rng(width)
    rows = [(i, v, int(draw.integers(labels))) for i, v in enumerate(vectors(draw, 700, width, digits))]
    again = rows[7]
    rows += [again, again, (50, rows[3][1], 1), (7, rows[4][1], 0), (7, rows[4][1], 1), (None, again[1], 0), (701, None, 0), (702, again[1], None), (703, [None] * width, 0)]
    rows += [(704, [float("nan")] * width, 0), (705, [float("inf")] * width, 1), (706, [0.0] * width, 0), (750, [0.0] * width, 1), (707, [1.0] * (width + 1), 0), (800, [1.0] * (width + 1), 1), (850, [], 0), (801, [], 0), (802, [], 1)]
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_scores_beyond_doubles(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.integers(1, 1 << 20, 4) * 2.0 + 0.25], i % 3) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, hn.hard_negatives(frame).collect())) == brute(rows)
    assert hn.products(np.array([[2.0**31 - 1, 1.0]]), np.array([[2.0**31 - 1, 1.0]])).tolist() == [[(2**31 - 1) ** 2 + 1]]


def test_a_third_of_all_rows_is_one_vector(spark):
    draw = np.random.default_rng(2)
    rows = [(i, v, 0 if i % 3 else 1) for i, v in enumerate(vectors(draw, 600, 4, 2))]
    rows += [(i, [0.5, 0.4, 0.3, 0.2], i % 2) for i in range(600, 900)]
    assert Counter(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_empty_tables_and_clashing_columns(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.6, 0.0], 1), (3, [0.9, 0.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as V", "3 as windows", "4 as anchor", "5 as `a.b`", "6 as asks")
    assert list(map(tuple, hn.hard_negatives(frame).collect())) == [(0, 1, 1, 2, 230 * 256, 153 * 256)]
    assert hn.hard_negatives(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0


def test_only_what_can_count_leaves_a_task(spark, monkeypatch):
    """Pairs that are sorted: some for each anchor and stripe, not one for each row."""
    seen = []
    monkeypatch.setattr(hn, "emit", lambda p, n, *a, f=hn.emit: (seen.extend((p.count(), n.count())), f(p, n, *a))[1])
    draw = np.random.default_rng(3)
    rows = [(i, v, i % 4) for i, v in enumerate(vectors(draw, 3000, 8, 4))]
    assert Counter(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert seen[0] == 60 * 5 and seen[1] <= 60 * 15 * 3
