"""Operators on the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.vectors import doubles, layer_norm, rms_norm
from lexiloom.operators.pooling import (
    attention_pool,
    causal_pool,
    causal_pool_whole,
    explode_vector,
    label_votes,
    lookup_sum,
    mean_vectors,
    nearest,
    softmax_weights,
)
from lexiloom.sources.tables import spread, table

BLOCK = 8
NEIGHBOURS = 16
FEW_NEIGHBOURS = 5
# small blocks, so that the test tables too have several
SMALL_BLOCK = 128
WHOLE_BLOCK = 1024


def _vectors(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "embeddings"), "vec_id")


def vector_lookup_sum(spark: SparkSession, directory: str) -> DataFrame:
    """Document ids as tokens, their place in blocks of eight as positions."""
    vectors = _vectors(spark, directory).select("vec_id", "embedding")
    positions = mean_vectors(vectors.withColumn("pos", F.col("vec_id") % BLOCK), "pos", "embedding")
    sequence = table(spark, directory, "documents").select(
        F.col("doc_id").alias("vec_id"), (F.col("doc_id") % BLOCK).alias("pos")
    )
    summed = lookup_sum(sequence, vectors, positions, "vec_id", "pos", "embedding")
    return explode_vector(summed.select("vec_id", "embedding"), "embedding")


def _norm_query(norm):
    def run(spark: SparkSession, directory: str) -> DataFrame:
        rows = _vectors(spark, directory).select("vec_id", norm(F.col("embedding")).alias("v"))
        return explode_vector(rows, "v")

    return run


def _weighted(spark: SparkSession, directory: str) -> DataFrame:
    """The rows nearest to the mean vector of each label, with their softmax weights."""
    rows = _vectors(spark, directory).select("vec_id", "label", "embedding")
    means = mean_vectors(rows, "label", "embedding")
    queries = means.select(F.col("label").alias("query_id"), F.col("embedding").alias("query"))
    return softmax_weights(nearest(rows, queries, "vec_id", "embedding", NEIGHBOURS))


def softmax_knn(spark: SparkSession, directory: str) -> DataFrame:
    votes = label_votes(_weighted(spark, directory), "label")
    return votes.select("query_id", "label", F.round("p", 6).alias("p"))


def attention_pool_query(spark: SparkSession, directory: str) -> DataFrame:
    pooled = attention_pool(_weighted(spark, directory), "embedding")
    return pooled.select("query_id", "dim", F.round("value", 6).alias("value"))


def nearest_weighted(spark: SparkSession, directory: str) -> DataFrame:
    """The rows nearest to every row among all vectors, each scaled by its label plus one; norms bound the search."""
    scaled = F.transform(doubles(F.col("embedding")), lambda x: x * (F.col("label") + 1))
    rows = _vectors(spark, directory).select("vec_id", scaled.alias("v"))
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    found = nearest(rows, queries, "vec_id", "v", FEW_NEIGHBOURS, SMALL_BLOCK)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def causal_pool_query(spark: SparkSession, directory: str) -> DataFrame:
    rows = _vectors(spark, directory).select("vec_id", doubles(F.col("embedding")).alias("embedding"))
    return explode_vector(causal_pool(rows, "vec_id", "embedding", BLOCK), "embedding")


def causal_pool_whole_query(spark: SparkSession, directory: str) -> DataFrame:
    """All vectors of a label as one sequence."""
    rows = _vectors(spark, directory).select("vec_id", "label", "embedding")
    return explode_vector(causal_pool_whole(rows, "label", "vec_id", "embedding", WHOLE_BLOCK), "embedding")


QUERIES = {
    "vector_lookup_sum": vector_lookup_sum,
    "rms_norm": _norm_query(rms_norm),
    "layer_norm": _norm_query(layer_norm),
    "softmax_knn": softmax_knn,
    "attention_pool": attention_pool_query,
    "nearest_weighted": nearest_weighted,
    "causal_pool": causal_pool_query,
    "causal_pool_whole": causal_pool_whole_query,
}

_CELLS = """
  SELECT vec_id, label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"""

_WEIGHTED = f"""
  WITH cells AS MATERIALIZED ({_CELLS}),
  means AS MATERIALIZED (SELECT label AS query_id, dim, avg(x) AS q FROM cells GROUP BY label, dim),
  scores AS (SELECT query_id, vec_id, label, round(sum(q * x) / sqrt(count(*)::DOUBLE), 9) AS score
             FROM cells JOIN means USING (dim) GROUP BY query_id, vec_id, label),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores),
  top AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM ranked WHERE r <= {NEIGHBOURS}),
  weighted AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM top)"""

ORACLE = {
    "vector_lookup_sum": f"""
      WITH cells AS ({_CELLS}),
      positions AS (SELECT vec_id % {BLOCK} AS pos, dim, avg(x) AS m FROM cells GROUP BY 1, 2)
      SELECT vec_id, CASE WHEN m IS NOT NULL THEN dim END AS dim, round(x + m, 6) AS value
      FROM (SELECT doc_id AS vec_id, doc_id % {BLOCK} AS pos FROM documents)
      LEFT JOIN cells USING (vec_id) LEFT JOIN positions USING (pos, dim)""",
    "rms_norm": f"""
      SELECT vec_id, dim, round(x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-5::DOUBLE), 6) AS value FROM ({_CELLS})""",
    "layer_norm": f"""
      WITH centred AS (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM ({_CELLS}))
      SELECT vec_id, dim, round(c / sqrt(avg(c * c) OVER (PARTITION BY vec_id) + 1e-5::DOUBLE), 6) AS value FROM centred""",
    "softmax_knn": _WEIGHTED + " SELECT query_id, label, round(sum(p), 6) AS p FROM weighted GROUP BY query_id, label",
    "attention_pool": _WEIGHTED + """
      SELECT query_id, dim, round(sum(p * x), 6) AS value FROM weighted JOIN cells USING (vec_id) GROUP BY query_id, dim""",
    "nearest_weighted": f"""
      WITH scaled AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings),
      scores AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.v, r.v) / sqrt(len(q.v)::DOUBLE), 9) AS score
                 FROM scaled q, scaled r)
      SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
      WHERE rank <= {FEW_NEIGHBOURS}""",
    "causal_pool": f"""
      WITH cells AS MATERIALIZED ({_CELLS}),
      scores AS (SELECT q.vec_id, k.vec_id AS seen, sum(q.x * k.x) / sqrt(count(*)::DOUBLE) AS s
                 FROM cells q JOIN cells k ON q.vec_id // {BLOCK} = k.vec_id // {BLOCK} AND k.vec_id <= q.vec_id AND q.dim = k.dim
                 GROUP BY q.vec_id, k.vec_id),
      exps AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM scores),
      weights AS (SELECT vec_id, seen, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM exps)
      SELECT weights.vec_id, dim, round(sum(w * x), 6) AS value
      FROM weights JOIN cells ON cells.vec_id = seen GROUP BY weights.vec_id, dim""",
    "causal_pool_whole": f"""
      WITH cells AS MATERIALIZED ({_CELLS}),
      scores AS (SELECT q.vec_id, k.vec_id AS seen, sum(q.x * k.x) / sqrt(count(*)::DOUBLE) AS s
                 FROM cells q JOIN cells k ON q.label = k.label AND k.vec_id <= q.vec_id AND q.dim = k.dim
                 GROUP BY q.vec_id, k.vec_id),
      exps AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM scores),
      weights AS (SELECT vec_id, seen, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM exps)
      SELECT weights.vec_id, dim, round(sum(w * x), 6) AS value
      FROM weights JOIN cells ON cells.vec_id = seen GROUP BY weights.vec_id, dim""",
}
