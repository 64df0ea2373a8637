from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.vectors import layer_norm, rms_norm
from lexiloom.operators import pooling

RNG = np.random.default_rng(1)


def vectors(spark, n, d=6):
    data = RNG.normal(size=(n, d)).astype(np.float32)
    rows = [(i, i % 3, [float(x) for x in v]) for i, v in enumerate(data)]
    return data.astype(np.float64), spark.createDataFrame(rows, "id int, label int, v array<float>")


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def test_norms(spark):
    data, df = vectors(spark, 5)
    rows = df.select("id", rms_norm(F.col("v")).alias("r"), layer_norm(F.col("v")).alias("l")).collect()
    for r in rows:
        x = data[r["id"]]
        assert r["r"] == pytest.approx(x / np.sqrt((x * x).mean() + 1e-5))
        assert r["l"] == pytest.approx((x - x.mean()) / np.sqrt(x.var() + 1e-5))


def test_causal_pooling(spark):
    data, df = vectors(spark, 21)
    pooled = {r["id"]: r["v"] for r in pooling.causal_pool(df, "id", "v", 8).collect()}
    assert len(pooled) == 21
    for i in range(21):
        seen = data[i // 8 * 8 : i + 1]
        weights = softmax(seen @ data[i] / np.sqrt(6))
        assert pooled[i] == pytest.approx(weights @ seen, rel=1e-6)
    with pytest.raises(ValueError):
        pooling.causal_pool(df, "id", "v", 0)


@pytest.mark.parametrize("per_block", [pooling.QUERIES_PER_BLOCK, 3])
def test_nearest_rows(spark, monkeypatch, per_block):
    """Few queries are sent to the tasks, many are joined block by block; both are exact."""
    monkeypatch.setattr(pooling, "QUERIES_PER_BLOCK", per_block)
    monkeypatch.setattr(pooling, "ROWS_PER_PART", 7)
    data, df = vectors(spark, 40)
    queries = df.where("id < 10").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    found = pooling.softmax_weights(pooling.nearest(df.repartition(5), queries, "id", "v", 4))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["p"]
    assert len(got) == 10
    for q in range(10):
        scores = np.round(data @ data[q] / np.sqrt(6), 9)
        best = sorted(range(40), key=lambda i: (-scores[i], i))[:4]
        assert got[q] == pytest.approx(dict(zip(best, softmax(scores[best]))))
    votes = pooling.label_votes(found, "label").groupBy("query_id").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1.0) for r in votes)
    pooled = pooling.attention_pool(found, "v").where("query_id = 0").orderBy("dim").collect()
    weights = np.array(list(got[0].values()))
    assert [r["value"] for r in pooled] == pytest.approx(weights @ data[list(got[0])])


@pytest.mark.parametrize("spread, most", [(0.0, 1.0), (3.0, 0.6)])
def test_norms_bound_the_search(spark, monkeypatch, spread, most):
    """Results are exact; the more norms differ, the fewer pairs are scored. Zero vectors are rows and queries too."""
    monkeypatch.setattr(pooling, "ROWS_PER_PART", 30)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 6))
    data *= np.exp(spread * rng.normal(size=200))[:, None] / np.linalg.norm(data, axis=1)[:, None]
    data[[7, 8]] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id int, v array<double>")
    queries = rows.select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    found = pooling.nearest(rows.repartition(3), queries, "id", "v", 4, 16).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["id"])
    scores = np.round(data @ data.T / np.sqrt(6), 9)
    for q in range(200):
        assert got[q] == sorted(range(200), key=lambda i: (-scores[q, i], i))[:4]
    schema = pooling.T.StructType([*rows.schema.fields, queries.schema["query_id"], pooling.T.StructField("score", pooling.T.DoubleType())])
    _, share = pooling.bounded_search(rows, queries, "v", "id", 4, schema, 16)
    assert 0 < share <= most


def test_more_neighbours_than_rows(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id int, v array<double>")
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("query"))
    found = pooling.nearest(rows, queries, "id", "v", 5, 4)
    assert found.count() == 60
    assert pooling.nearest(rows.limit(0), queries, "id", "v", 5, 4).count() == 0


def test_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "id int, v array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<double>")
    found = pooling.nearest(df.repartition(3), queries, "id", "v", 4)
    assert sorted(r["id"] for r in found.collect()) == [0, 1, 2, 3]
    assert pooling.nearest(df, queries.limit(0), "id", "v", 4).count() == 0


def test_lookup_sum(spark):
    data, df = vectors(spark, 6)
    positions = spark.createDataFrame([(0, [1.0] * 6), (1, [2.0] * 6)], "pos int, v array<float>")
    sequence = spark.createDataFrame([(0, 3, 0), (1, 3, 1), (2, 5, 0), (3, 99, 0)], "at int, id int, pos int")
    got = {r["at"]: r["v"] for r in pooling.lookup_sum(sequence, df, positions, "id", "pos", "v").collect()}
    assert got == {0: pytest.approx(data[3] + 1), 1: pytest.approx(data[3] + 2), 2: pytest.approx(data[5] + 1), 3: None}


def test_mean_vectors(spark):
    data, df = vectors(spark, 11)
    got = {r["label"]: r["v"] for r in pooling.mean_vectors(df.repartition(4), "label", "v").collect()}
    assert got == {k: pytest.approx(data[k::3].mean(axis=0)) for k in range(3)}


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_causal_pooling_over_whole_sequences(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(i), int(i) % 3, [float(x) for x in 30 * rng.normal(size=4)]) for i in rng.permutation(60)]
    df = spark.createDataFrame(rows, "id int, seq int, v array<double>")
    got = {r["id"]: r["v"] for r in pooling.causal_pool_whole(df, "seq", "id", "v", block).collect()}
    assert len(got) == 60
    for i, s, v in rows:
        seen = np.array([w for j, t, w in rows if t == s and j <= i])
        scores = seen @ np.array(v) / 2
        weights = np.exp(scores - scores.max())
        assert got[i] == pytest.approx(list(weights @ seen / weights.sum()))


def test_whole_sequences_of_nothing(spark):
    df = spark.createDataFrame([], "id int, seq int, v array<double>")
    assert pooling.causal_pool_whole(df, "seq", "id", "v", 4).collect() == []
    with pytest.raises(ValueError):
        pooling.causal_pool_whole(df, "seq", "id", "v", 0)


def test_long_sequences_have_longer_blocks_and_not_more(spark):
    """A row is sent to a bounded number of blocks, however long its sequence is and however its keys lie."""
    ids = [*range(3000), *(10**9 + 7 * i for i in range(3000))]
    rows = spark.createDataFrame([(1, i, [1.0, 0.0]) for i in ids] + [(2, 5, [1.0, 0.0])], "seq int, id bigint, v array<double>")
    placed = pooling._sequence_blocks(rows, 8).orderBy("seq", "id").collect()
    at = [r["at"] for r in placed if r["seq"] == 1]
    assert at == sorted(at) and len(set(at)) == placed[0]["blocks"] == pooling.SEQUENCE_BLOCKS
    assert max(at.count(b) for b in set(at)) <= 1.2 * len(ids) / pooling.SEQUENCE_BLOCKS
    assert (placed[-1]["at"], placed[-1]["blocks"]) == (0, 1)


def test_more_queries_make_larger_blocks(spark, monkeypatch):
    """Each row is sent to a bounded number of query blocks; scores are found some queries at a time."""
    monkeypatch.setattr(pooling, "QUERY_BLOCKS", 3)
    monkeypatch.setattr(pooling, "QUERIES_AT_ONCE", 7)
    met, cogrouped = [], pooling._cogrouped

    def counted(rows, queries, *args):
        met.append(rows.select("_block").distinct().count())
        return cogrouped(rows, queries, *args)

    monkeypatch.setattr(pooling, "_cogrouped", counted)
    data, df = vectors(spark, 90)
    queries = df.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("query"))
    got = {}
    for r in sorted(pooling.nearest(df, queries, "id", "v", 3, 4).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["id"])
    scores = np.round(data @ data.T / np.sqrt(6), 9)
    assert got == {q: sorted(range(90), key=lambda i: (-scores[q, i], i))[:3] for q in range(90)}
    assert met[0] == 3
