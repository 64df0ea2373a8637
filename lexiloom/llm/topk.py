"""Exact top-k inner products with a pivot-distance index.

Vectors become integers, ``floor(256 * x)``. Every vector is keyed by its nearest pivot and its distance to
it; the distances of a pivot are cut into annuli of a bounded number of rows. For a query, the triangle
inequality bounds the distance to an annulus from below, and with the largest norm in it, the inner product
from above. A first pass scores the annuli of the best bounds, until they hold ``k`` rows besides the
query's copies; the k-th score found is the query's threshold, and the second pass scores all annuli whose
bound reaches it. No bound below the threshold can hold a result, so the answer is exact.

Queries meet vectors in blocks: a join of annulus blocks with blocks of queries, one matrix product each.
Equal vectors are indexed once with their ``k + 1`` smallest ids, which are all that can be results.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids;
shorter vectors count as padded with zeros; repeated rows count once; an empty table, or one without queries,
gives no rows. All other vectors take part: sums are exact modulo 2**64, and a component or score that fits no
64-bit integer raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import stored
from lexiloom.shipping import ship

ship(__name__)

SCALE = 256
#: Vectors that pivots and annulus borders are fitted on; all vectors are indexed by them.
FIT_ROWS = 4096
#: Pivots grow with the square root of the rows, between these.
PIVOTS = 16
MOST_PIVOTS = 256
ANNULI = 8
#: Rows of an annulus block and of a query block.
BLOCK_ROWS = 1024
QUERY_ROWS = 512


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers as a matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances; computed from differences, so that they have no cancellation."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], 1)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer matrices: by doubles where these hold all sums, else modulo 2**64."""
    left, right = queries.astype(np.float64), rows.astype(np.float64)
    scores = left @ right.T
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, rows.shape[1])
    if most < 2**53:
        return scores.astype(np.int64)
    if np.abs(scores).max(initial=0) >= 2.0**63 * (1 - 1e-9):
        raise ValueError("a score fits no 64-bit integer")
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def fit_pivots(sample: np.ndarray, count: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Pivots by farthest-first choice and three rounds of means, and inner annulus borders of each."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen].astype(np.float64)
    for _ in range(3):
        near = distances(sample, pivots).argmin(1)
        pivots = np.stack([sample[near == i].mean(0) if (near == i).any() else p for i, p in enumerate(pivots)])
    between = distances(sample, pivots)
    near, cuts = between.argmin(1), np.linspace(0, 1, ANNULI + 1)[1:-1]
    own = [between[near == i, i] for i in range(len(pivots))]
    return pivots, np.stack([np.quantile(d if len(d) else np.zeros(1), cuts) for d in own])


def key_batches(pivots: np.ndarray, borders: np.ndarray, width: int):
    """Adds (cell, distance, norm): the annulus, the distance to its pivot and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vector"), width).astype(np.float64)
            between = distances(rows, pivots)
            near = between.argmin(1)
            own = between[np.arange(len(rows)), near]
            cell = near * ANNULI + (borders[near] < own[:, None]).sum(1)
            norm = np.sqrt((rows**2).sum(1))
            added = [pa.array(cell.astype(np.int32)), pa.array(own), pa.array(norm)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "cell", "distance", "norm"])

    return run


def bounds(queries: np.ndarray, pivots: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    """The largest inner product that each query can have with a vector of each cell."""
    to_pivot = distances(queries, pivots)[:, cells["pivot"]]
    gap = np.maximum(0, np.maximum(cells["low"] - to_pivot, to_pivot - cells["high"]))
    square = (queries**2).sum(1)[:, None]
    norm = cells["norm"]
    upper = np.minimum((square + norm**2 - gap**2) / 2, np.sqrt(square) * norm)
    # far above the rounding of the double arithmetic before
    return upper * (1 + 1e-9) + np.abs(square) * 1e-9 + 1


def visit_batches(pivots: np.ndarray, cells: dict[str, np.ndarray], width: int, k: int, again: bool):
    """(cell, part, queries, vectors, thresholds): blocks of queries for each annulus block they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_ROWS):
                piece = batch.slice(low, QUERY_ROWS)
                upper = bounds(matrix(piece.column("vector"), width).astype(np.float64), pivots, cells)
                order = np.argsort(-upper, 1)
                held = np.cumsum(cells["rows"][order], 1) - cells["rows"][order]
                first = np.zeros(upper.shape, bool)
                np.put_along_axis(first, order, held <= k, 1)
                visits = first
                if again:
                    known = piece.column("threshold").cast(pa.float64(), safe=False).fill_null(-np.inf)
                    visits = ~first & (upper >= known.to_numpy(zero_copy_only=False)[:, None])
                for c in np.flatnonzero(visits.any(0)):
                    chosen = pa.array(np.flatnonzero(visits[:, c]))
                    ids, vectors = piece.column("id").take(chosen), piece.column("vector").take(chosen)
                    n = len(chosen)
                    for part in range(int(cells["parts"][c])):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([int(cells["cell"][c])], pa.int32()),
                                pa.array([part], pa.int32()),
                                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), vectors),
                            ],
                            ["cell", "part", "queries", "vectors"],
                        )

    return run


def best_batches(width: int, k: int):
    """(query, id, score): the best ``k`` of every query in each pair of blocks, ties to smaller ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                queries = row.column("queries").flatten().to_numpy()
                entries = row.column("rows").flatten()
                lists = entries.field("ids")
                sizes = np.diff(lists.offsets.to_numpy())
                ids = lists.flatten().to_numpy()
                scores = products(
                    matrix(row.column("vectors").flatten(), width), matrix(entries.field("vector"), width)
                )
                scores = np.repeat(scores, sizes, 1)
                own = queries[:, None] == ids[None, :]
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores, own))[:, :k]
                kept = ~np.take_along_axis(own, order, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.broadcast_to(queries[:, None], order.shape)[kept]),
                        pa.array(ids[order][kept]),
                        pa.array(np.take_along_axis(scores, order, 1)[kept]),
                    ],
                    ["query", "id", "score"],
                )

    return run


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, with integer components."""
    too_large = F.raise_error(F.lit("a component times 256 fits no 64-bit integer")).cast("bigint")
    scaled = lambda x: x.cast("double") * SCALE
    grid = F.transform(vector_col, lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(too_large))
    sound = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(
        F.col(id_col).cast("bigint").alias("id"), grid.alias("vector")
    )


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` rows of the highest inner product with each query row."""
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col)
    wanted = quantised(df.where(is_query), id_col, vector_col).distinct()
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    unique = (
        rows.distinct()
        .withColumn("_n", smallest)
        .where(F.col("_n") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    unique = stored(unique, "vectors")
    width = unique.agg(F.max(F.size("vector"))).first()[0] or 0
    sample = unique.orderBy(F.xxhash64("vector")).limit(FIT_ROWS).select("vector").collect()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not sample:
        return spark.createDataFrame([], result)
    fitted = np.zeros((len(sample), width))
    for i, row in enumerate(sample):
        fitted[i, : len(row[0])] = row[0]
    count = min(MOST_PIVOTS, max(PIVOTS, round(unique.count() ** 0.5) // PIVOTS))
    pivots, borders = fit_pivots(fitted, count)
    schema = "ids array<bigint>, vector array<bigint>, cell int, distance double, norm double"
    index = stored(unique.select("ids", "vector").mapInArrow(key_batches(pivots, borders, width), schema), "index")
    held = (
        index.groupBy("cell")
        .agg(F.min("distance"), F.max("distance"), F.max("norm"), F.sum(F.size("ids")), F.count("*"))
        .orderBy("cell")
        .collect()
    )
    cell, low, high, norm, n, vectors = (np.array(c) for c in zip(*held))
    parts = -(-vectors // BLOCK_ROWS)
    cells = {
        "cell": cell, "pivot": cell // ANNULI, "low": low, "high": high, "norm": norm, "rows": n, "parts": parts,
    }
    part = F.pmod(F.xxhash64("vector"), F.element_at(F.lit(_parts(cell, parts, len(pivots))), F.col("cell") + 1)).cast("int")
    blocks = (
        index.select("cell", part.alias("part"), F.struct("ids", "vector").alias("row"))
        .groupBy("cell", "part")
        .agg(F.collect_list("row").alias("rows"))
    )
    visit = "cell int, part int, queries array<bigint>, vectors array<array<bigint>>"

    def scored(asked: DataFrame, again: bool) -> DataFrame:
        visits = asked.mapInArrow(visit_batches(pivots, cells, width, k, again), visit)
        pairs = visits.join(blocks, ["cell", "part"]).select("queries", "vectors", "rows")
        return _best(pairs.mapInArrow(best_batches(width, k), "query bigint, id bigint, score bigint"), k)

    first = stored(scored(wanted, False), "first-pass")
    reached = first.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("threshold"))
    rest = scored(wanted.join(reached, "id", "left"), True)
    return _best(first.select("query", "id", "score").unionByName(rest.select("query", "id", "score")), k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )


def _parts(cell: np.ndarray, parts: np.ndarray, pivots: int) -> list[int]:
    count = dict(zip(cell.tolist(), parts.tolist()))
    return [int(count.get(c, 1)) for c in range(pivots * ANNULI)]


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
