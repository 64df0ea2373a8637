"""Text quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

A word has two forms: its lower-cased bytes, and its shape (capitals, digits, signs, length, last sign,
whether it repeats the word before). Pairs of words and up to three shapes in a row are hashed to ``2**BITS``
weights; a feature's value is its share among the text's n-grams of its family. A text's score is one sparse
dot product.

Training uses at most ``train_rows`` labelled texts, those of the smallest id hashes, whole. They are dealt
to ``SHARDS`` tasks; each runs follow-the-regularised-leader-proximal updates over its rows from the state
of the round before, and the states are averaged. The model, of fixed size, is all that is broadcast.

Defined results: null and empty texts get the score of the bias alone; without usable labels every score is
0.5; ids that are null count as the empty text where an id is hashed; several labels of one id count as their
smallest; equal rows get equal scores; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices, stored, text_or_empty
from lexiloom.llm.splitting import mix, span_hashes
from lexiloom.llm.words import LOWER, word_spans
from lexiloom.shipping import ship

ship(__name__)

BITS = 18
TRAIN_ROWS = 8192
SHARDS = 6
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
#: What a family's shares are multiplied with, so that texts of many n-grams have features of a useful size.
SCALE = 16.0


def shapes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for the look of each word."""
    last = values[ends - 1]
    capital = (values >= 65) & (values <= 90)
    digit = (values >= 48) & (values <= 57)
    letter = capital | ((values >= 97) & (values <= 122)) | (values >= 128)
    size = ends - starts

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.int32)
        np.cumsum(kind, out=sums[1:])
        n = sums[ends] - sums[starts]
        return np.where(n == 0, 0, np.where(n == size, 3, np.where(n == 1, 1, 2)))

    sign = np.where(letter[ends - 1] | digit[ends - 1], 0, last.astype(np.int64))
    parts = (share(capital), share(digit), share(letter), np.minimum(size, 12), sign)
    out = np.zeros(len(starts), np.int64)
    for part, width in zip(parts, (4, 4, 4, 16, 256)):
        out = out * width + part
    return out


def families(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight numbers, rows) of each family of n-grams, rows ascending."""
    values, starts, ends, owner = word_spans(column)
    if not len(starts):
        return []
    word = span_hashes(LOWER[values], starts, ends)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    shape = (shapes(values, starts, ends) * 2 + same).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for family, (form, order) in enumerate([(word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)]):
            n = len(form) - order + 1
            if n <= 0:
                continue
            code = np.full(n, family + 1, np.uint64)
            for back in range(order):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + form[back : back + n])
            whole = owner[:n] == owner[order - 1 :]
            out.append(((code[whole] >> np.uint64(64 - BITS)).astype(np.int64), owner[:n][whole]))
    return out


def dot_products(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The sparse dot product of every row; the last weight is the bias."""
    out = np.full(len(column), float(weights[-1]))
    for numbers, rows in families(column):
        n = np.bincount(rows, minlength=len(column))
        out += SCALE * np.bincount(rows, weights[numbers], len(column)) / np.maximum(n, 1)
    return out


def sparse_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight numbers, values) of every row, the bias included."""
    found = families(column)
    out = []
    for row in range(len(column)):
        numbers, shares = [np.array([1 << BITS])], [np.ones(1)]
        for codes, rows in found:
            low, high = np.searchsorted(rows, [row, row + 1])
            seen, n = np.unique(codes[low:high], return_counts=True)
            numbers.append(seen)
            shares.append(SCALE * n / max(1, high - low))
        merged, at = np.unique(np.concatenate(numbers), return_inverse=True)
        out.append((merged, np.bincount(at, np.concatenate(shares))))
    return out


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state: the minimiser of the linearised losses with both penalties."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def update(z: np.ndarray, n: np.ndarray, numbers: np.ndarray, values: np.ndarray, label: float) -> None:
    """One text's update of the state, in place."""
    weights = leader(z[numbers], n[numbers])
    p = 1 / (1 + np.exp(-np.clip(weights @ values, -35, 35)))
    gradient = (p - label) * values
    step = (np.sqrt(n[numbers] + gradient**2) - np.sqrt(n[numbers])) / ALPHA
    z[numbers] += gradient - step * weights
    n[numbers] += gradient**2


def train_batches(state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = (part.copy() for part in state.value)
        seen = 0
        for batch in slices(batches, "text"):
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for (numbers, values), label in zip(sparse_rows(batch.column("text")), labels):
                update(z, n, numbers, values, float(label))
                seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([z.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([seen], pa.int64())],
                ["z", "n", "rows"],
            )

    return run


def id_hash(id_col: str) -> Column:
    return F.crc32(text_or_empty(id_col).cast("binary"))


def sample(
    df: DataFrame, labels: DataFrame, label_col: str, usable: Column, rows: int, id_col: str, text_col: str
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled texts: those of the smallest id hashes.

    The chosen labels are a table of bounded size, so only they are broadcast; ``usable`` is on ``id_col``.
    """
    known = (
        labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("doc_id"))
        .agg(F.min(label_col).cast("int").alias("label"))
    )
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # of several texts of one id, one: whichever sorts first
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(rows: DataFrame) -> np.ndarray:
    """Weights, the bias last, from (doc_id, text, label)."""
    spark = rows.sparkSession
    order = F.xxhash64("doc_id", F.lit("order"))
    rows = stored(rows.select("doc_id", "text", "label"), "quality-rows")
    dealt = rows.repartition(SHARDS, F.pmod(order, F.lit(SHARDS))).sortWithinPartitions(order).select("text", "label")
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))
        states = dealt.mapInArrow(train_batches(state), "z binary, n binary, rows bigint").collect()
        total = sum(s["rows"] for s in states)
        if not total:
            break
        z = sum(np.frombuffer(s["z"]) * (s["rows"] / total) for s in states)
        n = sum(np.frombuffer(s["n"]) * (s["rows"] / total) for s in states)
        state.unpersist()
    return leader(z, n)


def score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            dots = dot_products(batch.column("text"), model.value)
            yield batch.drop_columns("text").append_column("score", pa.array(1 / (1 + np.exp(-dots))))

    return run


def score(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_out_fold: int = 0,
    threshold: float = 0.3,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted) for each row; labels of the held-out fold are never learned."""
    fold = id_hash(id_col) % folds
    weights = train(sample(df, labels, label_col, fold != held_out_fold, train_rows, id_col, text_col))
    model = df.sparkSession.sparkContext.broadcast(weights)
    texts = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (fold == held_out_fold).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    scored = texts.mapInArrow(score_batches(model), "doc_id bigint, held_out boolean, score double")
    return scored.select(
        F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
