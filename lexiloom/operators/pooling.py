"""Vector tables: lookup sums, softmax pooling over the nearest rows, causal pooling in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.draws import bind
from lexiloom.functions.vectors import add, dot, doubles, softmax
from lexiloom.session import stored
from lexiloom.shipping import ship

ship(__name__)

# Up to this many queries are sent to every task; more are joined in blocks of about so many.
QUERIES_PER_BLOCK = 1024
ROWS_PER_PART = 20_000
QUERIES_AT_ONCE = 128
# Blocks that the queries are cut into at most, unless a block would hold over MOST_QUERIES.
QUERY_BLOCKS = 32
MOST_QUERIES = 1 << 15
# Norms of one bucket differ by this factor; the last bucket holds all smaller ones.
RATIO = 1.1
LEVELS = 256
# Blocks of a long sequence, each pooled by one task, and rows that one holds at most.
SEQUENCE_BLOCKS = 32
BLOCK_ROWS = 1 << 16
BLOCK_TASKS = 192
TILE = 1024
# Scores are rounded to nine digits.
SLACK = 1e-8


def lookup_sum(
    sequence: DataFrame, tokens: DataFrame, positions: DataFrame, token: str, position: str, vector: str
) -> DataFrame:
    """Replace the ids of a sequence by the sum of its token vector and its position vector.

    Every row of the sequence stays; its vector is NULL if its token or its position has none.
    """
    right = positions.withColumnRenamed(vector, "_position")
    return (
        sequence.join(tokens, token, "left")
        .join(right, position, "left")
        .withColumn(vector, add(F.col(vector), F.col("_position")))
        .drop("_position")
    )


def explode_vector(df: DataFrame, vector: str, digits: int = 6) -> DataFrame:
    """One row per dimension, rounded."""
    keep = [c for c in df.columns if c != vector]
    return df.select(*keep, F.posexplode_outer(vector).alias("dim", "_v")).select(
        *keep, "dim", F.round("_v", digits).alias("value")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean of the vectors of each value of ``by``: (``by``, ``vector``).

    Each batch is reduced to one sum per value and dimension before anything is shuffled.
    """

    def sums(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = batch.column(0).dictionary_encode()
            owner = groups.indices.to_numpy()
            vectors = _matrix(batch.column(1))
            totals = np.zeros((len(groups.dictionary), vectors.shape[1]))
            np.add.at(totals, owner, vectors)
            cells, dims = totals.shape
            group = np.repeat(np.arange(cells), dims)
            yield pa.RecordBatch.from_arrays(
                [
                    groups.dictionary.take(pa.array(group)),
                    pa.array(np.tile(np.arange(dims, dtype=np.int32), cells)),
                    pa.array(totals.ravel()),
                    pa.array(np.bincount(owner, minlength=cells)[group]),
                ],
                ["grp", "dim", "total", "n"],
            )

    kind = rows.schema[by].dataType.simpleString()
    cells = rows.select(by, vector).mapInArrow(sums, f"grp {kind}, dim int, total double, n bigint")
    means = cells.groupBy("grp", "dim").agg((F.sum("total") / F.sum("n")).alias("x"))
    # one entry per dimension
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return means.groupBy("grp").agg(ordered.alias("_v")).select(
        F.col("grp").alias(by), F.col("_v.x").alias(vector)
    )


def _top(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` largest scores, ties by key."""
    rows = np.arange(len(scores))
    if len(scores) > k:
        rows = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return rows[np.lexsort((keys[rows], -scores[rows]))[:k]]


def _best_rows(table, vector: str, key: str, query_ids: pa.Array, queries: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best rows of a batch for each query, ties by key."""
    rows = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    vectors = _matrix(rows.column(vector))
    keys = rows.column(key).to_numpy()
    take, best = [], []
    # some queries at a time, so that no table of all pairs arises
    for low in range(0, len(query_ids), QUERIES_AT_ONCE):
        scores = np.round(queries[low : low + QUERIES_AT_ONCE] @ vectors.T / np.sqrt(vectors.shape[1]), 9)
        some = [_top(own, keys, k) for own in scores]
        take += some
        best += [own[t] for own, t in zip(scores, some)]
    picked = rows.take(pa.array(np.concatenate(take)))
    owner = np.repeat(np.arange(len(query_ids)), [len(t) for t in take])
    best = np.concatenate(best)
    picked = picked.append_column("query_id", query_ids.take(pa.array(owner)))
    return picked.append_column("score", pa.array(best))


def _sent_to_tasks(rows: DataFrame, queries: pa.Table, vector: str, key: str, k: int, schema) -> DataFrame:
    ids = queries.column("query_id").combine_chunks()
    matrix = _matrix(queries.column("query"))

    def search(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _best_rows(batch, vector, key, ids, matrix, k).to_batches()

    return rows.mapInArrow(search, schema)


@dataclass(frozen=True)
class NormIndex:
    """Rows in buckets of falling norm, bucket ``i`` holding norms from ``top / RATIO**i`` downwards.

    ``norms`` is the largest norm and ``sizes`` the number of rows of each bucket; a bucket is cut into parts of about
    ``ROWS_PER_PART`` rows, numbered from the bucket of the largest norms on. There are at most ``LEVELS`` buckets.
    """

    top: float
    norms: list[float]
    sizes: list[int]

    @property
    def parts(self) -> list[int]:
        return [-(-n // ROWS_PER_PART) for n in self.sizes]

    @property
    def seed_parts(self) -> int:
        """Parts of the largest norms that hold about one part's rows together."""
        rows = taken = 0
        for n, parts in zip(self.sizes, self.parts):
            if rows + n >= ROWS_PER_PART:
                return taken + 1
            rows, taken = rows + n, taken + parts
        return taken

    @staticmethod
    def bucket(norm: Column, top: float) -> Column:
        steps = F.floor(F.ln(F.lit(top) / norm) / math.log(RATIO))
        return F.when(norm > 0, F.least(F.greatest(steps, F.lit(0)), F.lit(LEVELS - 1))).otherwise(LEVELS - 1).cast("int")

    @classmethod
    def of(cls, rows: DataFrame, vector: str) -> NormIndex:
        norms = rows.select(_norm(F.col(vector)).alias("norm"))
        top = norms.agg(F.max("norm")).first()[0] or 0.0
        found = norms.groupBy(cls.bucket(F.col("norm"), top).alias("b")).agg(F.max("norm"), F.count("*")).collect()
        held = {b: (norm, n) for b, norm, n in found}
        spans = [held.get(b, (0.0, 0)) for b in range(max(held, default=-1) + 1)]
        # an empty bucket takes the norm of the next one, so that norms never rise
        return cls(top, [max(s[0] for s in spans[i:]) for i in range(len(spans))], [s[1] for s in spans])


def _norm(vector: Column) -> Column:
    numbers = doubles(vector)
    return F.sqrt(dot(numbers, numbers))


def _looked_up(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), at)


def _cogrouped(rows: DataFrame, queries: DataFrame, vector: str, key: str, k: int, schema) -> DataFrame:
    """The ``k`` best of each ``_part`` of the rows for each query of each ``_block`` that it meets."""
    fields = [f.name for f in schema]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            none = left.slice(0, 0).append_column("query_id", right.column("query_id").slice(0, 0))
            return none.append_column("score", pa.array([], pa.float64())).select(fields)
        ids = right.column("query_id").combine_chunks()
        return _best_rows(left, vector, key, ids, _matrix(right.column("query")), k).select(fields)

    return rows.groupBy("_part", "_block").cogroup(queries.groupBy("_part", "_block")).applyInArrow(search, schema)


def _upto(n: Column) -> Column:
    return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)))


def bounded_search(
    rows: DataFrame, queries: DataFrame, vector: str, key: str, k: int, schema, per_block: int
) -> tuple[DataFrame, float]:
    """The rows that can be among the ``k`` best of each query, and the share of all pairs that is scored for it.

    By Cauchy and Schwarz, no row scores above the product of the two norms. A first pass scores about one part's rows of
    the largest norms, which gives each query a threshold, its ``k``-th best there. A query then meets only the buckets
    whose largest norm can reach it, and queries that need equally many buckets share blocks. Only bucket
    counts reach the driver. Where all norms are equal, nothing can be ruled out and all pairs are scored.
    """
    index = NormIndex.of(rows, vector)
    norm = _norm(F.col(vector))
    parts = index.parts
    before = [sum(parts[:i]) for i in range(len(parts) + 1)]
    bucket = index.bucket(norm, index.top)
    in_bucket = F.pmod(F.xxhash64(key), F.greatest(_looked_up(parts, F.col("_bucket")), F.lit(1)))
    placed = rows.withColumn("_bucket", bucket).withColumn("_part", _looked_up(before, F.col("_bucket")) + in_bucket)
    queries = queries.select("query_id", "query", _norm(F.col("query")).alias("_norm"))

    # every row is sent to every block that it meets, so more queries make larger blocks, not more of them
    asking = queries.count()
    per_block = max(per_block, min(-(-asking // QUERY_BLOCKS), MOST_QUERIES))
    seed_blocks = -(-asking // per_block)
    first = placed.where(F.col("_part") < index.seed_parts).withColumn("_part", F.lit(0).cast("bigint"))
    first = first.withColumn("_block", _upto(F.lit(seed_blocks).cast("bigint")))
    asked = queries.withColumns(
        {"_part": F.lit(0).cast("bigint"), "_block": F.pmod(F.xxhash64("query_id"), F.lit(seed_blocks))}
    )
    seeds = _cogrouped(first.drop("_bucket"), asked, vector, key, k, schema)
    # of fewer than k seeds no threshold follows
    least = seeds.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("_least"))
    reach = F.array(*[F.lit(n) for n in index.norms]) if index.norms else F.array().cast("array<double>")
    root = F.sqrt(F.size("query"))
    reached = F.filter(reach, lambda n: n * F.col("_norm") * (1 + SLACK) / root + SLACK >= F.col("_least"))
    level = F.when(F.col("_least").isNull(), F.lit(len(parts))).otherwise(F.size(reached))
    levelled = stored(queries.join(least, "query_id", "left").withColumn("_level", level), "levelled")

    counts = {r["_level"]: r["n"] for r in levelled.groupBy("_level").agg(F.count("*").alias("n")).collect()}
    blocks = [-(-counts.get(at, 0) // per_block) for at in range(len(parts) + 1)]
    # blocks of queries that need more buckets come first, so that those a bucket meets are the first ones
    begins = [sum(blocks[at + 1 :]) for at in range(len(blocks))]
    of_level = F.pmod(F.xxhash64("query_id"), F.greatest(_looked_up(blocks, F.col("_level")), F.lit(1)))
    left = placed.withColumn("_block", _upto(_looked_up(begins, F.col("_bucket")))).drop("_bucket")
    right = levelled.select(
        "query_id", "query", (_looked_up(begins, F.col("_level")) + of_level).alias("_block"),
        _upto(_looked_up(before, F.col("_level"))).alias("_part"),
    )
    pairs = sum(n * sum(index.sizes[:at]) for at, n in counts.items())
    every = sum(counts.values()) * sum(index.sizes)
    return _cogrouped(left, right, vector, key, k, schema), pairs / max(every, 1)


def nearest(
    rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, per_block: int | None = None
) -> DataFrame:
    """The ``k`` rows with the largest scaled dot product for each ``queries(query_id, query)``.

    Each batch of rows gives only its own ``k`` best per query, so that no pair table arises. Up to ``per_block``
    queries travel to the tasks; for more, norms bound which rows a query meets. Query ids are unique.
    """
    per_block = per_block or QUERIES_PER_BLOCK
    schema = T.StructType(
        [*rows.schema.fields, queries.schema["query_id"], T.StructField("score", T.DoubleType())]
    )
    queries = queries.select("query_id", doubles(F.col("query")).alias("query"))
    few = queries.limit(per_block + 1).toArrow()
    if few.num_rows <= per_block:
        found = _sent_to_tasks(rows if few.num_rows else rows.limit(0), few, vector, key, k, schema)
    else:
        found, _ = bounded_search(rows, queries, vector, key, k, schema, per_block)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def softmax_weights(found: DataFrame) -> DataFrame:
    """Add the weight ``p`` of each row found: the softmax of the scores of its query."""
    of_query = Window.partitionBy("query_id")
    e = F.exp(F.col("score") - F.max("score").over(of_query))
    return found.withColumn("_e", e).withColumn(
        "p", F.col("_e") / F.greatest(F.sum("_e").over(of_query), F.lit(1e-9))
    ).drop("_e")


def label_votes(weighted: DataFrame, label: str) -> DataFrame:
    """Summed weight of each label among the rows found."""
    return weighted.groupBy("query_id", label).agg(F.sum("p").alias("p"))


def attention_pool(weighted: DataFrame, vector: str) -> DataFrame:
    """Weighted sum of the vectors found: (query_id, dim, value)."""
    return (
        weighted.select("query_id", "p", F.posexplode(vector).alias("dim", "x"))
        .groupBy("query_id", "dim")
        .agg(F.sum(F.col("p") * F.col("x").cast("double")).alias("value"))
    )


def causal_pool(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Each row pools the rows up to itself in its block of ``block`` consecutive keys.

    Keys are unique, so a block is one group of at most ``block`` rows.
    """
    if block <= 0:
        raise ValueError("block must be positive")
    item = F.struct(F.col(key), doubles(F.col(vector)).alias("v"))
    blocks = rows.groupBy(F.floor(F.col(key) / block).alias("_block")).agg(
        F.array_sort(F.collect_list(item)).alias("seq")
    )

    def pooled(row: Column, i: Column) -> Column:
        seen = F.slice(F.col("seq"), F.lit(1), i + 1)
        scores = F.transform(seen, lambda s: dot(row["v"], s["v"]) / F.sqrt(F.size(row["v"])))
        parts = bind(
            softmax(scores),
            lambda w: F.zip_with(w, seen, lambda p, s: F.transform(s["v"], lambda x: p * x)),
        )
        zeros = F.transform(row["v"], lambda x: F.lit(0.0))
        return F.struct(row[key].alias(key), F.aggregate(parts, zeros, add).alias(vector))

    return blocks.select(F.explode(F.transform("seq", pooled)).alias("r")).select("r.*")


def _sequence_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Add to ``rows(seq, id, v)`` the number ``at`` of the row's block in its sequence and the number of ``blocks``.

    Blocks hold at least about ``block`` consecutive rows, and longer sequences have longer blocks, not more of them:
    at most ``SEQUENCE_BLOCKS``, unless these would hold over ``BLOCK_ROWS`` rows. Only the cuts of sequences of
    over ``block`` rows are broadcast, less than one for each ``block`` rows.
    """
    sizes = rows.groupBy("seq").agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    most = max(SEQUENCE_BLOCKS, -(-longest // BLOCK_ROWS))
    shares = F.array(*[F.lit(i / most) for i in range(1, most)])
    cuts = rows.groupBy("seq").agg(
        F.count("*").alias("n"), F.percentile_approx("id", shares, F.lit(max(1000, 4 * most))).alias("all_cuts")
    )
    blocks = F.least(F.ceil(F.col("n") / block), F.lit(most)).cast("int")
    used = F.transform(
        F.sequence(F.lit(1), F.col("blocks") - 1), lambda i: F.get("all_cuts", F.floor(i * most / F.col("blocks")).cast("int") - 1)
    )
    long = cuts.where(F.col("n") > block).withColumn("blocks", blocks).select("seq", "blocks", used.alias("cuts"))
    before = F.size(F.filter("cuts", lambda c: c < F.col("id")))
    return (
        rows.where(F.col("seq").isNotNull())
        .join(F.broadcast(long), "seq", "left")
        .withColumn("at", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(before))
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .drop("cuts")
    )


class _Pooled:
    """The softmax state of a block's rows over what came so far: largest score, sum of exponentials, weighted sum."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.top = np.full(len(ids), -np.inf)
        self.total, self.sum = np.zeros(len(ids)), np.zeros(vectors.shape)

    def see(self, ids: np.ndarray, vectors: np.ndarray, own: bool) -> None:
        """Add rows of an earlier block or, with ``own``, of the block itself, of which each row sees those up to it."""
        root = np.sqrt(max(vectors.shape[1], 1))
        for low in range(0, len(self.ids), TILE):
            rows = slice(low, low + TILE)
            for first in range(0, len(ids), TILE):
                seen = vectors[first : first + TILE]
                scores = self.vectors[rows] @ seen.T / root
                if own:
                    scores[ids[None, first : first + TILE] > self.ids[rows, None]] = -np.inf
                top = np.maximum(self.top[rows], scores.max(1))
                # rows that have seen nothing so far stay as they are
                base = np.where(np.isfinite(top), top, 0)
                weights = np.exp(scores - base[:, None])
                scale = np.exp(self.top[rows] - base)
                self.total[rows] = self.total[rows] * scale + weights.sum(1)
                self.sum[rows] = self.sum[rows] * scale[:, None] + weights @ seen
                self.top[rows] = top

    def results(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        pooled = self.sum / self.total[:, None]
        for low in range(0, len(pooled), TILE):
            part = pooled[low : low + TILE]
            bounds = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
            lists = pa.ListArray.from_arrays(bounds, pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[low : low + TILE]).cast(kind), lists], ["id", "v"])


def _pool_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v) of every block of rows (seq, at, earlier, id, v) that are sorted by the first three columns."""
    block, held, state = None, [], None

    def opened() -> _Pooled:
        ids, vectors = (np.concatenate(c) for c in zip(*held))
        pooled = _Pooled(ids, vectors)
        pooled.see(ids, vectors, own=True)
        return pooled

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("id").type
        names = batch.column("seq").dictionary_encode()
        seq = names.indices.to_numpy()
        at, earlier = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "earlier"))
        ids, vectors = batch.column("id").to_numpy(), _matrix(batch.column("v"))
        changed = (seq[1:] != seq[:-1]) | (at[1:] != at[:-1]) | (earlier[1:] != earlier[:-1])
        ends = [*(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        low = 0
        for high in ends:
            of = (names.dictionary[int(seq[low])].as_py(), int(at[low]))
            if of != block:
                if held:
                    yield from (state or opened()).results(kind)
                block, held, state = of, [], None
            if earlier[low]:
                state = state or opened()
                state.see(ids[low:high], vectors[low:high], own=False)
            else:
                held.append((ids[low:high], vectors[low:high]))
            low = high
    if held:
        yield from (state or opened()).results(kind)


def causal_pool_whole(rows: DataFrame, by: str, key: str, vector: str, block: int) -> DataFrame:
    """Each row pools all rows of its sequence ``by`` up to itself, however long the sequence is: (key, vector).

    Sequences are cut into blocks of at least about ``block`` consecutive rows, at most ``SEQUENCE_BLOCKS`` of them. A block
    is a group of its own: it holds its own rows, and the rows of all earlier blocks stream past, from Spark's sorter. Each
    row has one softmax state, the largest score, the sum of the exponentials below it and the weighted sum of
    the vectors, which is rescaled when a larger score comes. So every row is sent to at most as many blocks as there
    are in its sequence, whatever the number of rows, and no state is shuffled. Keys are unique.
    """
    if block <= 0:
        raise ValueError("block must be positive")
    named = rows.select(F.col(by).alias("seq"), F.col(key).alias("id"), F.col(vector).alias("v"))
    placed = _sequence_blocks(named, block)
    sent = placed.withColumn("to", F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)))
    sent = sent.select("seq", F.col("to").alias("at"), (F.col("at") < F.col("to")).alias("earlier"), "id", "v")
    # explicit, so that blocks of few bytes and long work are not put together
    tasks = max(BLOCK_TASKS, rows.sparkSession.sparkContext.defaultParallelism)
    grouped = sent.repartition(tasks, "seq", "at").sortWithinPartitions("seq", "at", "earlier")
    kind = rows.schema[key].dataType.simpleString()
    pooled = grouped.mapInArrow(_pool_blocks, f"id {kind}, v array<double>")
    return pooled.select(F.col("id").alias(key), F.col("v").alias(vector))
