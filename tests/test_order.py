from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.draws import draw, draw_index, shuffle_key
from lexiloom.operators.order import draw_rows, first_in_order, running, shuffled, split_head, split_tail, with_offsets


def expected_order(n, seed=42):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_shuffle_positions(spark):
    got = shuffled(spark.range(1000), "id").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1000))
    assert [r["id"] for r in got] == expected_order(1000)
    assert shuffled(spark.range(1000), "id", limit=7).count() == 7
    assert [r["id"] for r in first_in_order(spark.range(1000), "id", 5).collect()] == expected_order(1000)[:5]


def test_positions_do_not_depend_on_the_partitioning(spark):
    one = shuffled(spark.range(500).repartition(1), "id").collect()
    many = shuffled(spark.range(500).repartition(13), "id").collect()
    assert sorted(one) == sorted(many)


@pytest.mark.parametrize("n, held_out", [(1, 0), (2, 1), (9, 1), (10, 1), (11, 1), (20, 2), (1000, 100)])
def test_tail_split(spark, n, held_out):
    rows = split_tail(spark.range(n), "id").collect()
    assert {r["id"] for r in rows if r["split"] == "val"} == set(expected_order(n)[n - held_out :])
    assert len(rows) == n


@pytest.mark.parametrize("n, ratio, held_out", [(1, 0.05, 1), (10, 0.05, 1), (100, 0.05, 5), (11, 0.49, 5), (1000, 0.49, 490)])
def test_head_split(spark, n, ratio, held_out):
    rows = split_head(spark.range(n), "id", ratio).collect()
    assert {r["id"] for r in rows if r["split"] == "eval"} == set(expected_order(n)[:held_out])
    assert len(rows) == n


@pytest.mark.parametrize("ratio", [0, 0.5, 1, -0.1])
def test_head_split_rejects_ratios(spark, ratio):
    with pytest.raises(ValueError):
        split_head(spark.range(3), "id", ratio)


def test_offsets_leave_no_gap(spark):
    docs = spark.range(300).withColumn("n", F.col("id") % 7)
    rows = sorted(with_offsets(docs, "id", F.col("n"), name="first").collect(), key=lambda r: (r["first"], r["n"]))
    at = 0
    for r in sorted(rows, key=lambda r: expected_order(300).index(r["id"])):
        assert r["first"] == at
        at += r["n"]


@pytest.mark.parametrize("how", ["sum", "min", "last"])
def test_running_values_cross_buckets(spark, how):
    values = [5, None, 3, 8, 3, 1, None, 9, 0, 4]
    rows = [(g, i, v) for g in "ab" for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = running(df, how, F.col("v"), F.floor(F.col("i") / 3), ["i"], ("g",)).collect()
    for r in got:
        before = [v for v in values[: r["i"]] if v is not None]
        if how == "sum":
            assert r["running"] == sum(before)
        else:
            wanted = (min(before) if how == "min" else before[-1]) if before else None
            assert r["running"] == wanted


def test_draws_hit_every_row_about_equally(spark):
    drawn = draw_rows(spark.range(20_000).withColumnRenamed("id", "draw"), "draw", spark.range(10), "id", 1)
    counts = {r["id"]: r["count"] for r in drawn.groupBy("id").count().collect()}
    assert len(counts) == 10 and sum(counts.values()) == 20_000
    assert all(1700 < n < 2300 for n in counts.values())


def test_draw_is_the_leading_hash_bits(spark):
    df = spark.range(50).select("id", draw(F.col("id"), 1000, 7).alias("d"), draw(F.col("id"), 10**12, 7).alias("e"))
    for r in df.collect():
        digest = hashlib.md5(f"7:{r['id']}".encode()).hexdigest()
        assert r["d"] == int(digest[:8], 16) % 1000
        assert r["e"] == int(digest[:15], 16) % 10**12


def test_shuffle_key(spark):
    row = spark.range(1).select(shuffle_key(F.col("id"), "s")).first()
    assert row[0] == hashlib.md5(b"s:0").hexdigest()


@pytest.mark.parametrize("r, index", [(0.0, 0), (0.25, 0), (0.26, 1), (0.5, 1), (0.9, 2), (1.5, 2)])
def test_draw_index(spark, r, index):
    probs = F.array(F.lit(0.25), F.lit(0.25), F.lit(0.4))
    assert spark.range(1).select(draw_index(probs, F.lit(r))).first()[0] == index
