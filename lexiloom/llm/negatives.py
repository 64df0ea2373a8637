"""Hard negatives by Four-Russians scoring.

Vectors become integers, ``floor(256 * x)``. For every eight dimensions of an anchor, a table holds its sums over
all 256 subsets of them. Candidates are packed into bit planes: for each bit of their components and each eight
dimensions, one byte says which components have the bit, so it is an index into the anchor's table. The inner
product is the sum of the looked-up entries, shifted by the bit's place (the highest, the sign, counts down). All
anchors meet all candidates this way, in blocks, and every score is exact.

A first pass scores each anchor against its own label and keeps its positives; the second scores it against the
other labels and keeps, for each positive, the best candidates whose score is in the band below the positive's.
Candidates are dealt to cells by a hash and lie in them by label, so no label makes a block large; anchors are
dealt to groups; a task holds one cell and one group.

Defined results: null ids, labels and vectors, and vectors with null or non-finite components take no part; shorter
vectors count as padded with zeros; repeated rows count once; rows of one id with different vectors are rows of
their own, but no row is a positive or negative of its own id; an empty table gives no rows. Sums are exact
modulo 2**64; a component or score that fits no 64-bit integer raises an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import stored
from lexiloom.shipping import ship

ship(__name__)

SCALE = 256
#: Dimensions of a table.
GROUP = 8
#: Candidates of a cell and anchors of a group, on average.
CELL_ROWS = 4096
GROUP_ROWS = 1024
#: Anchors and candidates that are scored at once: their tables and scores stay in the cache.
ANCHORS_AT_ONCE = 64
ROWS_AT_ONCE = 2048
LEAST = np.iinfo(np.int64).min

CELL = "cell int, ids binary, labels binary, planes binary, bits int, most double"
SCORED = "anchor_key bigint, anchor_id bigint, place int, id bigint, score bigint"


def grid(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of components as integers, padded with zeros to whole groups of eight."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(values).max(initial=0) >= 2.0**63:
        raise ValueError("a component times 256 fits no 64-bit integer")
    out = np.zeros((len(sizes), -(-width // GROUP) * GROUP), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values.astype(np.int64)
    return out


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """Bytes by (bit, group, row): which of a row's eight components have the bit, in two's complement."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)) - 1)
    bits = most.bit_length() + 1
    planes = [np.packbits((rows >> k & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(bits)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Tables by (group, subset, anchor), each subset's sum from that without its last member."""
    groups = anchors.shape[1] // GROUP
    columns = anchors.T.reshape(groups, GROUP, len(anchors)).astype(kind)
    out = np.zeros((groups, 1 << GROUP, len(anchors)), kind)
    for j in range(GROUP):
        np.add(out[:, : 1 << j], columns[:, j : j + 1], out=out[:, 1 << j : 2 << j])
    return out


def look_up(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products by (row, anchor): each plane's entries are added up, from the sign down, and shifted."""
    bits, groups, n = planes.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    for k in range(bits - 1, -1, -1):
        plane = tables[0].take(planes[k, 0], axis=0)
        for g in range(1, groups):
            plane += tables[g].take(planes[k, g], axis=0)
        if k == bits - 1:
            np.negative(plane, out=plane)
        total <<= 1
        total += plane
    return total


def scores(anchors: np.ndarray, planes: np.ndarray, most: float) -> np.ndarray:
    """Inner products by (anchor, row) of one block, where ``most`` is the longest row's length."""
    bound = float(np.sqrt((anchors.astype(np.float64) ** 2).sum(1)).max(initial=0)) * most
    if bound >= 2.0**62:
        _check_range(anchors, planes)
    tables = subset_sums(anchors, np.int32 if bound < 2.0**30 else np.int64)
    pieces = [look_up(tables, planes[:, :, low : low + ROWS_AT_ONCE]) for low in range(0, planes.shape[2], ROWS_AT_ONCE)]
    return np.concatenate(pieces).T.astype(np.int64) if pieces else np.zeros((len(anchors), 0), np.int64)


def _check_range(anchors: np.ndarray, planes: np.ndarray) -> None:
    shifts = np.exp2(np.arange(len(planes)))
    shifts[-1] *= -1
    spread = np.unpackbits(planes, axis=1, bitorder="little").astype(np.float64)
    rows = np.tensordot(shifts, spread, 1)
    if np.abs(anchors.astype(np.float64) @ rows).max(initial=0) >= 2.0**63 * (1 - 1e-9):
        raise ValueError("a score fits no 64-bit integer")


def pack_cell(width: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One row per cell: its candidates by label and id, in bit planes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        rows = grid(table.column("vector"), width)[order]
        planes = bit_planes(rows)
        most = float(np.sqrt((rows.astype(np.float64) ** 2).sum(1)).max(initial=0))
        columns = [
            pa.array([key[0].as_py()], pa.int32()),
            pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()),
            pa.array([labels[order].astype(np.int64).tobytes()], pa.binary()),
            pa.array([planes.tobytes()], pa.binary()),
            pa.array([len(planes)], pa.int32()),
            pa.array([most]),
        ]
        return pa.Table.from_arrays(columns, ["cell", "ids", "labels", "planes", "bits", "most"])

    return run


def best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest of ``values``, ties to smaller ids."""
    if len(values) > 4 * k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        at = np.flatnonzero(values >= least)
    else:
        at = np.arange(len(values))
    return at[np.lexsort((ids[at], -values[at]))[:k]]


def _found(parts: list[tuple]) -> pa.Table:
    names = ["anchor_key", "anchor_id", "place", "id", "score"]
    kinds = [np.int64, np.int64, np.int32, np.int64, np.int64]
    columns = zip(*parts) if parts else [[]] * len(names)
    joined = [np.concatenate([np.empty(0, kind), *column]).astype(kind) for kind, column in zip(kinds, columns)]
    return pa.Table.from_arrays([pa.array(c) for c in joined], names)


def score_cells(width: int, pick: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores a group of anchors against one cell; ``pick`` chooses what to keep of each anchor's scores."""

    def run(cells: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if not asked.num_rows:
            return _found(parts)
        asked = asked.sort_by("label")
        vectors = grid(asked.column("vector"), width)
        anchor_labels = asked.column("label").to_numpy()
        columns = {c: asked.column(c).to_pylist() for c in asked.column_names if c not in ("vector", "label")}
        for i in range(cells.num_rows):
            row = {c: cells.column(c)[i].as_py() for c in cells.column_names}
            ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            planes = np.frombuffer(row["planes"], np.uint8).reshape(row["bits"], vectors.shape[1] // GROUP, len(ids))
            for low in range(0, len(vectors), ANCHORS_AT_ONCE):
                high = min(low + ANCHORS_AT_ONCE, len(vectors))
                parts += pick(columns, anchor_labels, low, high, vectors, ids, labels, planes, row["most"])
        return _found(parts)

    return run


def _entry(key: int, anchor: int, place: int, ids: np.ndarray, values: np.ndarray) -> tuple:
    n = len(ids)
    return np.full(n, key, np.int64), np.full(n, anchor, np.int64), np.full(n, place, np.int32), ids, values


def pick_positives(k: int) -> Callable:
    """The ``k`` best of the anchor's own label. Only that label's rows of the cell are scored."""

    def pick(columns, anchor_labels, low, high, vectors, ids, labels, planes, most):
        while low < high:
            label = anchor_labels[low]
            end = min(high, int(np.searchsorted(anchor_labels, label, side="right")))
            first, last = np.searchsorted(labels, label), np.searchsorted(labels, label, side="right")
            own_ids = ids[first:last]
            block = scores(vectors[low:end], planes[:, :, first:last], most)
            for i, values in enumerate(block, low):
                others = np.flatnonzero(own_ids != columns["anchor_id"][i])
                at = others[best(values[others], own_ids[others], k)]
                yield _entry(columns["anchor_key"][i], columns["anchor_id"][i], 0, own_ids[at], values[at])
            low = end

    return pick


def pick_negatives(k: int, floor: int, ceiling: int) -> Callable:
    """For each positive, the ``k`` best of other labels with ``floor`` to ``ceiling`` percent of its score."""

    def pick(columns, anchor_labels, low, high, vectors, ids, labels, planes, most):
        block = scores(vectors[low:high], planes, most)
        for i, values in enumerate(block, low):
            bands = [(p, -(-floor * s // 100), ceiling * s // 100) for p, s in enumerate(columns["positives"][i], 1)]
            bands = [(p, lowest, highest) for p, lowest, highest in bands if lowest <= highest]
            if not bands:
                continue
            at = np.flatnonzero((labels != anchor_labels[i]) & (ids != columns["anchor_id"][i]))
            at = at[values[at] >= min(lowest for _, lowest, _ in bands)]
            order = at[np.lexsort((ids[at], -values[at]))]
            sinking = -values[order]
            for p, lowest, highest in bands:
                first = int(np.searchsorted(sinking, -highest))
                last = min(first + k, int(np.searchsorted(sinking, -lowest, side="right")))
                kept = order[first:last]
                yield _entry(columns["anchor_key"][i], columns["anchor_id"][i], p, ids[kept], values[kept])

    return pick


def taking_part(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of the distinct rows that take part."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    present = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    return (
        df.where(present & finite)
        .select(
            F.col(id_col).cast("bigint").alias("id"),
            F.col(label_col).cast("bigint").alias("label"),
            F.transform(vector_col, lambda x: x.cast("double")).alias("vector"),
        )
        .distinct()
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    floor: int = 50,
    ceiling: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``floor`` and ``ceiling`` are whole percents of the positive's score. ``is_anchor`` is about ``id``,
    ``label`` and ``vector``, as they are in :func:`taking_part`.
    """
    rows = stored(taking_part(df, id_col, label_col, vector_col), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, size["width"] or 0)
    n_cells = max(1, -(-size["n"] // CELL_ROWS))
    key = F.xxhash64("id", "label", "vector")
    asked = rows.where(is_anchor).select(key.alias("anchor_key"), F.col("id").alias("anchor_id"), "label", "vector")
    n_groups = max(1, -(-asked.count() // GROUP_ROWS))
    cell = F.pmod(F.xxhash64(F.lit(1), "id", "label", "vector"), F.lit(n_cells)).cast("int")
    packed = stored(rows.withColumn("cell", cell).groupBy("cell").applyInArrow(pack_cell(width), CELL), "cells")
    at = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.pmod("anchor_key", F.lit(n_groups)).cast("int")

    def scored(anchors: DataFrame, pick: Callable) -> DataFrame:
        left = packed.withColumn("group", at(n_groups)).groupBy("cell", "group")
        right = anchors.withColumn("group", group).withColumn("cell", at(n_cells)).groupBy("cell", "group")
        return left.cogroup(right).applyInArrow(score_cells(width, pick), SCORED)

    near = stored(_ranked(scored(asked, pick_positives(positives)), positives), "positives")
    listed = near.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("ranked"))
    known = asked.join(listed.select("anchor_key", F.col("ranked.score").alias("positives")), "anchor_key")
    far = _ranked(scored(known, pick_negatives(negatives, floor, ceiling)), negatives)
    far = far.select("anchor_key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select(
        "anchor_key",
        "anchor_id",
        F.col("rank").alias("place"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return near.join(far, ["anchor_key", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
