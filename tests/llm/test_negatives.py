from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import negatives
from lexiloom.llm.negatives import best, bit_planes, look_up, mine, scores, subset_sums

KIND = "vec_id bigint, embedding array<float>, label int, id string, cell int, anchor_key int"


def brute(rows, every=5, positives=5, kept=3):
    grid = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        grid[i] = ([math.floor(256 * float(np.float32(x))) for x in v], label)
    out = []
    for a, (v, label) in grid.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (w, _) in grid.items() if i != a)
        for s, p in [x for x in scored if grid[x[1]][1] == label][:positives]:
            fits = [(t, i) for t, i in scored if grid[i][1] != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fits[:kept], 1)]
    return sorted(out)


def found(spark, rows, every=5):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], KIND)
    return sorted(tuple(r) for r in mine(df, F.col("id") % every == 0).collect())


def clustered(n, seed=1, width=12, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width)) + 0.6
    return [(i, [float(x) for x in np.float32(spread * (centres[i % 4] + rng.normal(size=width)))], i % 4) for i in range(n)]


def test_equals_brute_force(spark):
    rows = clustered(300)
    want = brute(rows)
    assert found(spark, rows) == want and len(want) > 100


def test_many_cells_groups_and_blocks(spark, monkeypatch):
    for name, value in [("CELL_ROWS", 40), ("GROUP_ROWS", 7), ("ANCHORS_AT_ONCE", 3), ("ROWS_AT_ONCE", 8)]:
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(200, 2)
    assert found(spark, rows) == brute(rows)


def test_ties_copies_and_repeated_rows(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(40)] + [(50, [1.0, 0.0], 1), (51, [0.45, 0.45], 0), (52, [0.4, 0.5], 1)]
    assert found(spark, rows + rows[:3]) == brute(rows)


def test_negative_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.5], 1), (2, [-0.7, 0.1], 2), (3, [0.0, 1.0], 1), (4, [0.0, -1.0], 2)]
    # a positive of score 0 takes negatives of score 0; one below 0 has an empty band
    assert found(spark, rows) == brute(rows) == [(0, 3, 1, 4, 0, 0)]


def test_rows_that_take_no_part(spark):
    odd = [
        (1, None, 1), (2, [1.0, None], 1), (3, [math.nan, 1.0], 2), (5, [math.inf, 0.0], 2), (None, [1.0, 1.0], 2),
        (6, [1.0, 0.9], None), (10, [1.0, 0.5], None),
    ]
    rows = [(0, [0.5, 0.9], 1), (15, [0.5, 0.8], 1), (20, [0.4, 0.7], 2), (25, [0.5, 0.7], 2)]
    assert found(spark, rows + odd) == brute(rows + odd) != []
    # an empty vector counts as zeros, a short one is padded
    short = [(30, [], 2), (35, [0.5], 2), (40, [0.9, 0.0], 1)]
    padded = [(i, [*v, 0.0, 0.0][:2], label) for i, v, label in short]
    assert found(spark, rows + short) == brute(rows + padded)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows) == []


def test_large_components_next_to_small_ones(spark):
    rows = clustered(60, 3) + [(100, [1e6, -1e6] * 6, 1), (105, [1e6, -0.9e6] * 6, 2), (110, [9e5, -1e6] * 6, 1)]
    assert found(spark, rows) == brute(rows)


def test_what_fits_no_integer_fails(spark):
    with pytest.raises(Exception, match="64-bit"):
        found(spark, [(0, [1e18], 1), (1, [1.0], 1)])
    with pytest.raises(Exception, match="64-bit"):
        found(spark, [(0, [1e9], 1), (1, [1e9], 1)])


@pytest.mark.parametrize("size", [1, 300, 1 << 20, 1 << 29, 1 << 40])
def test_lookups_equal_products(size):
    rng = np.random.default_rng(size)
    anchors, rows = rng.integers(-min(size, 1 << 18), min(size, 1 << 18) + 1, (5, 16)), rng.integers(-size, size + 1, (9, 16))
    want = anchors @ rows.T
    most = float(np.sqrt((rows.astype(float) ** 2).sum(1)).max())
    assert (scores(anchors, bit_planes(rows), most) == want).all()
    assert (look_up(subset_sums(anchors, np.int64), bit_planes(rows)) == want.T).all()


def test_best_takes_ties_by_id():
    values, ids = np.array([3, 5, 5, 5, 1] * 9), np.arange(45)[::-1]
    assert list(ids[best(values, ids, 4)]) == [1, 2, 3, 6]
