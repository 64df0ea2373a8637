from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import topk
from lexiloom.llm.topk import bounds, distances, fit_pivots, products, top_k

KIND = "vec_id bigint, embedding array<float>, ids string, cell int"


def brute(rows, k, every):
    grid = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        grid[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for q, v in grid.items():
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in grid.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, k=5, every=5):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % every == 0, k=k).collect())


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    return [(i, [float(x) for x in np.float32(centres[i % 6] + 0.2 * rng.normal(size=8))]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = clustered(300)
    assert found(spark, rows) == brute(rows, 5, 5)


def test_small_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rows = clustered(200, 2)
    assert found(spark, rows) == brute(rows, 5, 5)


def test_ties_copies_and_repeated_rows(spark):
    rows = [(i, [0.5, 0.5]) for i in range(40)] + [(50, [1.0, 0.0]), (51, [-1.0, -1.0])]
    assert found(spark, rows + rows[:3]) == brute(rows, 5, 5)


def test_rows_that_take_no_part(spark):
    odd = [(1, None), (2, []), (3, [1.0, None]), (5, [math.nan, 1.0]), (10, [math.inf, 0.0]), (None, [1.0, 1.0])]
    rows = [(0, [0.1, 0.9]), (15, [0.3, 0.3]), (20, [-0.4, 0.2])]
    got = found(spark, rows + odd)
    # an empty vector counts as zeros
    assert got == brute(rows + odd[:1] + [(2, [0.0, 0.0])] + odd[2:], 5, 5)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(0, [1.0])]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows) == []


def test_large_values_stay_exact():
    a = np.array([[2.0**26, 2.0**26 - 1, 3]])
    assert products(a, a)[0, 0] == 2**52 + (2**26 - 1) ** 2 + 9


def test_large_components_next_to_small_ones(spark):
    rows = clustered(60, 3) + [(100, [1e6, -1e6] * 4), (105, [1e6, -0.9e6] * 4), (111, [9e5, -1e6] * 4), (112, [3e5] + [0.0] * 7)]
    assert found(spark, rows) == brute(rows, 5, 5)


def test_exact_beyond_doubles():
    a, b = np.array([[2**40 + 1, 3, -(2**40)]]), np.array([[2**21 + 1, 2**40 + 7, 5]])
    assert products(a, b)[0, 0] == (2**40 + 1) * (2**21 + 1) + 3 * (2**40 + 7) - 5 * 2**40


def test_what_fits_no_integer_fails(spark):
    for rows in ([(0, [1e18]), (1, [1.0])], [(0, [1e9]), (1, [1e9])]):
        with pytest.raises(Exception, match="64-bit"):
            found(spark, rows)


def test_more_pivots_than_the_least(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIVOTS", 2)
    rows = clustered(400, 5)
    assert found(spark, rows) == brute(rows, 5, 5)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    rows, queries = np.floor(rng.normal(size=(200, 16)) * 50), np.floor(rng.normal(size=(20, 16)) * 50)
    pivots, _ = fit_pivots(rows)
    between = distances(rows, pivots)
    near = between.argmin(1)
    held = [between[near == i, i] for i in range(len(pivots))]
    some = [i for i in range(len(pivots)) if len(held[i])]
    cells = {
        "pivot": np.array(some),
        "low": np.array([held[i].min() for i in some]),
        "high": np.array([held[i].max() for i in some]),
        "norm": np.array([np.sqrt((rows[near == i] ** 2).sum(1)).max() for i in some]),
    }
    upper = bounds(queries, pivots, cells)
    for j, i in enumerate(some):
        assert ((queries @ rows[near == i].T).max(1) <= upper[:, j]).all()
