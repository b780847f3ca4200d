from __future__ import annotations

import numpy as np
import pytest

from rasterloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    asking = {}
    for i, v in ok:
        if i % 100 == 0 and (i not in asking or tuple(v) < tuple(asking[i])):
            asking[i] = v
    for q, v in asking.items():
        near = sorted((ann.exact(v[None], u[None])[0], i) for i, u in ok if i != q and len(u) == len(v))[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [3, 16])
def test_equals_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(ann, "TILE_ROWS", 64)
    monkeypatch.setattr(ann, "TILE_QUERIES", 3)
    draw = np.random.default_rng(width)
    rows = [(int(i), [float(np.float32(x)) for x in np.round(draw.normal(size=width), 1)], 0) for i in range(900)]  # rounded: many ties
    rows += [(900, rows[5][1], 0), (901, rows[5][1], 0), (901, rows[5][1], 0), (None, rows[1][1], 0), (902, None, 0), (903, [0.0] * width, 0), (1000, [float("nan")] * width, 0), (904, [None] * width, 0), (905, [1.0] * (width + 1), 0), (1100, [], 0), (906, [float("inf")] * width, 0)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_many_blocks_read_each_candidate_once(spark, monkeypatch):
    """Blocks of a few rows; each pass is one job over candidates and copied queries, and no query comes to the driver."""
    monkeypatch.setattr(ann, "BLOCK_BYTES", 600)
    frame = type(spark.range(1))
    for name in ("toLocalIterator", "collect", "toPandas"):  # but for one row, the tables' bytes
        monkeypatch.setattr(frame, name, lambda df, *a, f=getattr(frame, name): f(df, *a) if df.columns == ["bytes"] else pytest.fail("rows came to the driver"))
    joins = []
    monkeypatch.setattr(ann, "block_join", lambda c, q, i, j, k, f=ann.block_join: (joins.append((i, j)), f(c, q, i, j, k))[1])
    draw = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=4)], 0) for i in range(350)]
    found = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect())) == brute(rows)
    (a, b), (c, d) = joins
    assert a == 0 and b == c and d > 30 and b * b <= d


def test_a_grid_of_cells_and_a_hot_group(spark, monkeypatch):
    """Several parts of queries; a third of all rows is one vector, another third lies closer to it than int8 values tell."""
    for name, value in (("BLOCK_BYTES", 4000), ("QUERY_BYTES", 100), ("TILE_ROWS", 50), ("PAIRS", 16)):
        monkeypatch.setattr(ann, name, value)
    draw = np.random.default_rng(6)
    hot = draw.normal(size=8)
    kinds = (lambda: hot, lambda: hot + draw.normal(size=8) * 1e-5, lambda: draw.normal(size=8))
    for kind in ("float", "double"):
        rows = [(i, [float(np.float32(x) if kind == "float" else x) for x in kinds[i % 3]()], 0) for i in range(601)]
        found = ann.nearest_neighbours(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"))
        assert sorted(map(tuple, found.collect())) == brute(rows)


@pytest.mark.parametrize("gigabytes", [1, 10, 30])
def test_bytes_moved_follow_the_input(gigabytes):
    """Vectors of 64 floats, one of a hundred a query: what the grid moves stays below three times the input."""
    size, width = gigabytes << 30, 64
    rows = size // (4 * width)
    blocks, parts = ann.grid(rows, rows * (5 * width + 64), rows // 100 * (4 * width + 40))
    assert size * parts + size / 100 * blocks < 3 * size
    assert ann.grid(2000, 2000 * 384, 20 * 296) == (4, 1)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 2.5], 0)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as query_id", "2 as score")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.5)]
    assert ann.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold():
    draw = np.random.default_rng(1)
    a, b = (ann.Tile(np.arange(50), draw.normal(size=(50, 24)) * 10.0 ** draw.integers(-6, 6, (50, 1))) for _ in range(2))
    low, high = a.bounds(b)
    true = np.sqrt(((a.vectors[:, None] - b.vectors[None]) ** 2).sum(axis=2))
    assert (low <= true).all() and (true <= high).all()


def test_every_row_of_a_query_id_asks(spark):
    rows = [(0, [1.0, 1.0], 0), (0, [9.0, 9.0], 0), (0, [9.0, 9.0], 0), (1, [1.0, 2.0], 0), (2, [9.0, 8.5], 0), (2, [9.0, 8.5], 0), (100, [5.0, 5.0], 0)]
    want = []
    for q in (0, 100):  # as the SQL has it: all pairs of rows with different ids, ranked by query id
        pairs = sorted((ann.exact(np.array([v]), np.array([u]))[0], c) for i, v, _ in rows if i == q for c, u, _ in rows if c != q)[:10]
        want += [(q, r, c, d) for r, (d, c) in enumerate(pairs, 1)]
    assert sorted(map(tuple, ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())) == want
