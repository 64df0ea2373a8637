"""Near-duplicate detection by fast similarity sketching.

A document's set holds the hashes of its distinct five-word shingles. Its sketch is filled in rounds: in
round r, every element is thrown into one of ``COORDINATES`` bins by the round's hash, and a bin keeps its
smallest (round, hash) value; once all bins are full, the sketch is done. Rounds past the number of bins
throw everything into one bin each, so that every coordinate is filled for certain; equal coordinates of two
sketches estimate the similarity with the concentration of independent samples. Large sets are done after
one round.

Documents of equal sets form a class, and only one of each is compared further. ``BANDS`` bands of ``WIDTH``
coordinates are hashed; classes that share a band meet in a bucket, and equal buckets of several bands count
once. Within a bucket, the whole sets are compared exactly: the members, in blocks of bounded size, are
turned into a matrix over the shingles that at least two of them hold, and its product counts all
intersections. Only a spanning forest of the links found leaves a task. Connected components over classes
give the groups. A pair of similarity 0.75 meets in some bucket but for a chance of 2e-5; buckets have no cap.

Defined results: null texts and texts without words have empty sets and link with nothing; fewer than five
words are one shingle; rows that share an id count as one node; null ids link with nothing and form their
own component; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices, stored
from lexiloom.llm.components import components
from lexiloom.llm.splitting import mix, span_hashes
from lexiloom.llm.words import LOWER, word_spans
from lexiloom.shipping import ship

ship(__name__)

WORDS = 5
BANDS, WIDTH = 40, 5
COORDINATES = BANDS * WIDTH
#: A link: ``100 * intersection >= PERCENT * union``.
PERCENT = 75
#: Shingles and documents of a block, on average; two blocks of a bucket meet in a task. Few large blocks
#: repeat their members less often than many small ones; this size needs some 50 MB.
BLOCK_SHINGLES = 1 << 18
BLOCK_ROWS = 2048
GOLD = np.uint64(0x9E3779B97F4A7C15)
SUMMARY = "doc_id bigint, n_shingles bigint, first_mark bigint, second_mark bigint, bands array<bigint>"


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, row after row, each ascending, and the rows' sizes."""
    values, starts, ends, owner = word_spans(column)
    words = span_hashes(LOWER[values], starts, ends)
    rows = len(column)
    n = np.bincount(owner, minlength=rows)
    first = np.cumsum(n) - n
    codes, rows_of = [], []
    with np.errstate(over="ignore"):
        for size in range(1, WORDS + 1):
            if size < WORDS:
                at = first[n == size]
            else:
                at = np.flatnonzero(owner[: len(owner) - WORDS + 1] == owner[WORDS - 1 :]) if len(owner) >= WORDS else at[:0]
            if not len(at):
                continue
            code = np.full(len(at), size, np.uint64)
            for back in range(size):
                code = mix(code * GOLD + words[at + back])
            codes.append(code)
            rows_of.append(owner[at])
    if not codes:
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    code, row = np.concatenate(codes), np.concatenate(rows_of)
    order = np.argsort(code)
    order = order[np.argsort(row[order].astype(np.uint16 if rows < 1 << 16 else np.int64), kind="stable")]
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], np.bincount(row[new], minlength=rows)


def sketches(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sketch of every row; a row without elements keeps the largest value everywhere."""
    t = np.uint64(COORDINATES)
    empty = np.uint64(2**64 - 1)
    out = np.full((len(sizes), COORDINATES), empty)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        for r in range(2 * COORDINATES):
            if not len(codes):
                break
            thrown = mix(codes + np.uint64(r + 1) * GOLD)
            if r < COORDINATES:
                place = (thrown >> np.uint64(32)) * t >> np.uint64(32)
            else:
                place = np.uint64(r - COORDINATES)
            value = (np.uint64(r) << np.uint64(48)) | (mix(thrown) >> np.uint64(16))
            np.minimum.at(flat, owner * COORDINATES + np.asarray(place).astype(np.int64), value)
            unfilled = (out == empty).any(1)
            if not unfilled[owner].all():
                kept = unfilled[owner]
                codes, owner = codes[kept], owner[kept]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, WIDTH)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * GOLD
        for i in range(WIDTH):
            key = mix(key * np.uint64(3) + parts[:, :, i])
    return key.astype(np.int64)


def summary_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, two marks of the whole set and the band keys of every row."""
    for batch in slices(batches, "text"):
        codes, sizes = shingle_sets(batch.column("text"))
        some = np.flatnonzero(sizes)
        marks = np.zeros((2, len(sizes)), np.uint64)
        if len(some):
            begin = (np.cumsum(sizes) - sizes)[some]
            with np.errstate(over="ignore"):
                for i in range(2):
                    marks[i, some] = np.add.reduceat(mix(codes ^ (GOLD * np.uint64(i + 7))), begin)
        keys = band_keys(sketches(codes, sizes))[some]
        offsets = np.zeros(len(sizes) + 1, np.int32)
        offsets[1:] = np.cumsum((sizes > 0) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes.astype(np.int64)),
                pa.array(marks[0].astype(np.int64)),
                pa.array(marks[1].astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
            ],
            ["doc_id", "n_shingles", "first_mark", "second_mark", "bands"],
        )


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the rows of ``links`` connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in links.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def linked_rows(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All pairs of rows whose sets are similar, by an exact product over the shingles that rows share."""
    rows = len(sizes)
    owner = np.repeat(np.arange(rows), sizes)
    _, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    shared = n[at] > 1
    at, owner = at[shared], owner[shared]
    both = np.zeros((rows, rows), np.int32)
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    width = 1 << 11
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        first, last = np.searchsorted(at, [low, low + width])
        held = np.zeros((rows, width), np.float32)
        held[owner[first:last], at[first:last] - low] = 1
        # sums of up to 2,048 are exact in this type, longer ones are not
        both += (held @ held.T).astype(np.int32)
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    a, b = np.nonzero(np.triu(100 * both >= PERCENT * union, 1))
    return np.stack([a, b], 1)


def compare_block(table: pa.Table) -> pa.Table:
    """(a, b): a spanning forest of the links among the documents of one or two blocks."""
    table = table.combine_chunks()
    ids = table.column("doc_id").to_numpy()
    column = table.column("text")
    column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    codes, sizes = shingle_sets(column)
    edges = np.array(forest(linked_rows(codes, sizes)), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(ids[edges[:, 0]]), "b": pa.array(ids[edges[:, 1]])})


def links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of class representatives: enough links to connect all that are similar.

    ``texts`` are (doc_id, text), one per id, ``classes`` (doc_id, bands, n_shingles) of the representatives.
    """
    keys = classes.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    buckets = (
        keys.groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.sum("n_shingles").alias("held"),
            F.min("doc_id").alias("least"),
            F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sum"),
        )
        .where("n > 1")
        .groupBy("n", "held", "least", "sum")
        .agg(F.min("key").alias("key"))
        .select("key", "n", "held")
    )
    buckets = stored(buckets, "buckets")
    blocks = F.expr(f"cast(1 + greatest((held - 1) div {BLOCK_SHINGLES}, (n - 1) div {BLOCK_ROWS}) as int)")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    members = (
        keys.join(buckets, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id"
        )
    )
    met = members.join(texts, "doc_id")
    return met.groupBy("key", "low", "high").applyInArrow(compare_block, "a bigint, b bigint").distinct()


def mark_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = stored(texts.mapInArrow(summary_batches, SUMMARY), "sets")
    mark = ["first_mark", "second_mark", "n_shingles"]
    known = sets.where("n_shingles > 0 and doc_id is not null")
    least = stored(known.groupBy(*mark).agg(F.min("doc_id").alias("class")), "classes")
    classed = stored(known.select("doc_id", *mark).join(least, mark).select("doc_id", "class").distinct(), "classed")
    chosen = known.join(least, mark).where("doc_id = class").select("doc_id", "bands", "n_shingles").distinct()
    found = stored(links(texts.where("doc_id is not null"), chosen), "links")
    # an id with several texts is in several classes, which it links
    again = classed.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    edges = found.unionByName(again.where("a < b").select("a", "b"))
    grouped = components(edges)
    first_class = again.select("doc_id", F.col("a").alias("class"))
    placed = first_class.join(grouped, F.col("class") == F.col("node"), "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("component", "class").alias("_component")
    )
    joined = sets.select("doc_id", "n_shingles").join(placed, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group of near copies: the one of the smallest id."""
    dropped = mark_near_copies(df, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("_dropped")).distinct()
    return df.join(dropped, F.col(id_col).eqNullSafe(F.col("_dropped")), "left_anti")
