"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over the subsequences of three letters that both hold, the products of their
weights; an occurrence weighs ``DECAY`` to the power of the letters that it spans, up to ``SPAN``. Signs between
letters are left out before, and runs of single letters are joined into one word; two to ``FRAGMENTS``
neighbouring words of at most ``FRAGMENT`` letters also count as one word, besides each alone.

That kernel falls with every inserted letter, so a second view, the share of a landmark's close triples that a
word holds at any gaps within ``SPAN``, stands beside it: a letter between any or all letters of a landmark leaves
that share at 1. The larger of both, the share taken ``INSERTED`` times, is the likeness.

Landmarks are the word beginnings that are most unevenly divided between toxic and clean training texts,
without those that are much like a better one; both ends of a word count as letters. A sentence is described by its largest kernel value with
each landmark, relative to the landmark's own, mapped by the inverse root of the landmarks' kernel matrix
(Nyström); a linear support vector machine is trained on labelled sentences, of which a toxic text gives its
most toxic one, chosen anew in each round. A text's score is the probability fitted to the largest margin of
its sentences.

Words are scored once per distinct word of a batch. The largest weight that any landmark gives a triple bounds
them all, so only words above ``FLOOR`` are looked at in detail, and the same holds for shares and ``SHARE_FLOOR``;
words below both count as unlike every landmark, in training too.

Defined results: null and empty texts score like texts without any likeness; without usable labels of both
kinds every score is 0; several labels of one id count as their smallest; equal rows get equal scores; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices, stored
from lexiloom.llm.quality import id_hash, sample
from lexiloom.llm.splitting import mix, span_hashes
from lexiloom.llm.words import LOWER, word_spans
from lexiloom.shipping import ship

ship(__name__)

DECAY = 0.6
SPAN = 7
FLOOR = 0.5
#: Letters of the triples of a landmark that make up its share: with a letter in every gap they span up to ``SPAN``.
CLOSE = (SPAN + 1) // 2
#: Least share of a landmark's close triples that counts, and what a full share is worth beside the word itself.
SHARE_FLOOR = 0.6
INSERTED = 0.95
#: Letters of a fragment, and most neighbouring fragments that are joined.
FRAGMENT = 4
FRAGMENTS = 4
#: Most landmarks, and the candidates that they are chosen from.
LANDMARKS = 128
CANDIDATES = 2048
#: Least share of toxic texts among those that hold a landmark.
PURITY = 0.85
#: A candidate that is this like a chosen landmark, or holds one, is left out.
ALIKE = 0.95
#: The power of the relative kernel that the machine works with; a product of kernels is a kernel.
POWER = 4
#: Sentences of toxic texts that are this like a landmark are positive examples besides the most toxic one.
PLAIN = 0.5
#: Lengths, with the first mark, of the word beginnings that can be landmarks besides whole words.
SHORTEST_LANDMARK, LONGEST_LANDMARK = 5, 11
#: Least log-likelihood gain of a landmark, far above what any of a million unrelated words would reach.
LEAST_GAIN = 15.0
TRAIN_ROWS = 4096
#: Letters of a word that the kernel looks at once; longer words are cut with overlap.
LONGEST = 18
OVERLAP = 9
#: The same for shares, so that the longest landmark with a letter in every gap is looked at whole.
LONGEST_SPREAD = 2 * LONGEST
#: Spans whose shares are found at once.
SHARE_SPANS = 1 << 13
#: The letter that marks both ends of a word.
EDGE = 63
ROUNDS = 3
SENTENCE_ENDS = np.array([10, 13, 33, 46, 63], np.uint8)
BATCH_BYTES = 4 << 20


def alphabet() -> np.ndarray:
    """1 to 26 letters, 27 to 36 digits, up to 62 other bytes; 0 for ASCII signs, which are left out."""
    out = np.zeros(256, np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[48:58] = np.arange(27, 37)
    out[128:] = 37 + np.arange(128) % 26
    return out


def triples(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first positions, codes, weight) of the gapped triples of every word, a gap pattern at a time."""
    n = len(letters)
    room = np.zeros(n, np.int64)
    room[:] = np.repeat(ends, ends - starts) - np.arange(n) if n else 0
    wide = letters.astype(np.int32)
    for last in range(2, SPAN):
        at = np.flatnonzero(room > last)
        if not len(at):
            break
        base = wide[at] * 4096 + wide[at + last]
        for middle in range(1, last):
            yield at, base + wide[at + middle] * 64, DECAY ** (last + 1)


class Cells:
    """The cells of a matrix that are not 0, row by row: a triple belongs to few landmarks."""

    def __init__(self, dense: np.ndarray):
        rows, self.column = np.nonzero(dense)
        self.value = dense[rows, self.column]
        self.size = np.bincount(rows, minlength=len(dense))
        self.first = np.cumsum(self.size) - self.size

    def add(self, out: np.ndarray, owner: np.ndarray, rows: np.ndarray, weight: float = 1.0) -> None:
        """Add ``weight`` times each of ``rows`` to the row ``owner`` of ``out``, in that order."""
        n = self.size[rows]
        upto = np.cumsum(n)
        cell = np.repeat(self.first[rows] - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)
        # over flat cells, which numpy adds much faster than whole rows
        np.add.at(out.reshape(-1), np.repeat(owner * out.shape[1], n) + self.column[cell], weight * self.value[cell])


class Landmarks:
    """The triples of all landmarks: their weights, the landmarks' kernel matrix and the summed bound."""

    def __init__(self, words: list[bytes]):
        self.words = words
        letters = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        upto = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        parts = [(owner[at], code, np.full(len(at), w)) for at, code, w in triples(letters, upto - sizes, upto)]
        none = np.zeros(0, np.int64)
        who, code, weight = (np.concatenate(c) for c in zip(*parts)) if parts else (none, none, none)
        codes, at = np.unique(code, return_inverse=True)
        self.index = np.full(1 << 18, -1, np.int32)
        self.index[codes] = np.arange(len(codes))
        self.known = self.index >= 0
        table = np.zeros((len(codes), len(words)))
        np.add.at(table, (at, who), weight)
        self.gram = table.T @ table
        relative = table / np.maximum(self.gram.diagonal(), 1e-300)
        self.table = Cells(relative)
        self.bound = np.zeros(1 << 18)
        self.bound[codes] = relative.max(1, initial=0)
        close = np.zeros_like(table)
        near = weight > DECAY ** (CLOSE + 0.5)
        np.maximum.at(close, (at[near], who[near]), weight[near])
        close /= np.maximum(close.sum(0), 1e-300)
        self.share_bound = np.zeros(1 << 18)
        self.share_bound[codes] = close.max(1, initial=0)
        some = np.flatnonzero(close.any(1))
        self.close = Cells(close[some])
        self.close_index = np.full(1 << 18, -1, np.int32)
        self.close_index[codes[some]] = np.arange(len(some))

    def likeness(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kernel of each span with each landmark, relative to the landmark's kernel with itself."""
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        out = np.zeros((len(starts), len(self.words)))
        for at, code, weight in triples(letters, starts, ends):
            row = self.index[code]
            some = row >= 0
            self.table.add(out, owner[at[some]], row[some], weight)
        return out

    def share(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The share of each landmark's close triples that each span holds, at any gaps; 0 below ``SHARE_FLOOR``."""
        out = np.zeros((len(starts), len(self.words)))
        known = len(self.close.size)
        for low in range(0, len(starts), SHARE_SPANS):
            high = min(low + SHARE_SPANS, len(starts))
            begin = starts[low]
            inside = letters[begin : ends[high - 1]]
            owner = np.repeat(np.arange(high - low), ends[low:high] - starts[low:high])
            held = np.zeros((high - low, known), bool)
            for at, code, _ in triples(inside, starts[low:high] - begin, ends[low:high] - begin):
                row = self.close_index[code]
                some = row >= 0
                held[owner[at[some]], row[some]] = True
            span, row = np.nonzero(held)
            self.close.add(out, span + low, row)
        return np.where(out >= SHARE_FLOOR, out, 0)


def letter_words(column: pa.Array, codes: np.ndarray):
    """Letters of all words end to end, and start, end, row and sentence of each word.

    Sentences end after a word that ends in a stop and at line ends; runs of single letters are one word.
    """
    values, starts, ends, owner = word_spans(column)
    if not len(starts):
        return values[:0], starts, ends, owner, owner
    gap_break = np.zeros(len(values) + 1, np.int64)
    np.cumsum((values == 10) | (values == 13), out=gap_break[1:])
    stop = np.isin(values[ends - 1], SENTENCE_ENDS)
    new = np.ones(len(starts), bool)
    new[1:] = stop[:-1] | (gap_break[starts[1:]] != gap_break[ends[:-1]]) | (owner[1:] != owner[:-1])
    sentence = np.cumsum(new) - 1
    coded = codes[values]
    kept = coded > 0
    upto = np.zeros(len(values) + 1, np.int64)
    np.cumsum(kept, out=upto[1:])
    starts, ends = upto[starts], upto[ends]
    letters = coded[kept]
    some = ends > starts
    starts, ends, owner, sentence = starts[some], ends[some], owner[some], sentence[some]
    single = ends - starts == 1
    joins = np.zeros(len(starts), bool)
    joins[1:] = single[1:] & single[:-1] & (sentence[1:] == sentence[:-1])
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(starts)) - 1
    return letters, starts[first], ends[last], owner[first], sentence[first]


def fragments(starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(first words, number of words) of the runs of short neighbouring words of a sentence, a number at a time."""
    short = ends - starts <= FRAGMENT
    first = np.flatnonzero(short)
    for more in range(1, FRAGMENTS):
        first = first[first + more < len(starts)]
        first = first[short[first + more] & (sentence[first + more] == sentence[first])]
        yield first, more + 1


def pieces(
    starts: np.ndarray, ends: np.ndarray, longest: int = LONGEST, overlap: int = OVERLAP
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, start and end of the words, the long ones cut into overlapping pieces."""
    step = longest - overlap
    n = np.maximum(1, -(-(ends - starts - overlap) // step))
    word = np.repeat(np.arange(len(starts)), n)
    first = starts[word] + step * (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n))
    return word, first, np.minimum(first + longest, ends[word])


def spread_out(
    letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans copied end to end, each between ``edges`` marks, with their new starts and ends."""
    sizes = ends - starts
    upto = np.cumsum(sizes + 2 * edges)
    begin = upto - sizes - 2 * edges
    out = np.full(int(upto[-1]) if len(upto) else 0, EDGE, np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[inner + np.repeat(begin + edges, sizes)] = letters[inner + np.repeat(starts, sizes)]
    return out, begin, upto


def sentence_features(column: pa.Array, landmarks: Landmarks, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, largest likeness with each landmark) of the sentences that are like any landmark."""
    nothing = np.empty(0, np.int64), np.empty((0, len(landmarks.words)))
    letters, starts, ends, owner, sentence = letter_words(column, codes)
    if not len(starts):
        return nothing
    # the letters of neighbouring words are end to end, so joined words are spans too
    spans = [(starts, ends, owner, sentence)]
    spans += [
        (starts[i], ends[i + n - 1], owner[i], sentence[i]) for i, n in fragments(starts, ends, sentence) if len(i)
    ]
    hashes = np.concatenate([span_hashes(letters, low, high) for low, high, _, _ in spans])
    starts, ends, owner, sentence = (np.concatenate(c) for c in zip(*spans))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    flat, begin, upto = spread_out(letters, starts[first], ends[first], 1)
    held, shared = np.zeros(len(flat)), np.zeros(len(flat))
    for at, code, weight in triples(flat, begin, upto):
        some = landmarks.known[code]
        at, code = at[some], code[some]
        held[at] += landmarks.bound[code] * weight
        shared[at] += landmarks.share_bound[code]
    close = np.add.reduceat(held, begin) >= FLOOR
    spread = np.add.reduceat(shared, begin) >= SHARE_FLOOR
    likely = np.flatnonzero(close | spread)
    if not len(likely):
        return nothing
    by_word = np.zeros((len(likely), len(landmarks.words)))
    for some, view, worth, size in (
        (close[likely], landmarks.likeness, 1, (LONGEST, OVERLAP)),
        (spread[likely], landmarks.share, INSERTED, (LONGEST_SPREAD, LONGEST)),
    ):
        word, low, high = pieces(begin[likely[some]], upto[likely[some]], *size)
        np.maximum.at(by_word, np.flatnonzero(some)[word], worth * view(*spread_out(flat, low, high)))
    slot = np.full(len(first), -1)
    slot[likely] = np.arange(len(likely))
    there = np.flatnonzero(slot[number] >= 0)
    seen, at = np.unique(sentence[there], return_inverse=True)
    out = np.zeros((len(seen), len(landmarks.words)))
    np.maximum.at(out, at, by_word[slot[number[there]]])
    rows = np.zeros(len(seen), np.int64)
    rows[at] = owner[there]
    return rows, np.minimum(out, 1.2) ** POWER


def feature_batches(landmarks: Landmarks):
    codes = alphabet()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, found = sentence_features(batch.column("text"), landmarks, codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(list(found), pa.list_(pa.float64()))],
                ["doc_id", "likeness"],
            )

    return run


def vocabulary_batches(codes: np.ndarray):
    """(word, label, origin) of the distinct word beginnings of every text.

    ``origin`` is the smallest hash of the text's word triples: copies and most near copies share it.
    """

    edge, sizes = bytes([EDGE]), range(SHORTEST_LANDMARK, LONGEST_LANDMARK + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            letters, starts, ends, owner, _ = letter_words(batch.column("text"), codes)
            hashes = np.concatenate([span_hashes(letters, starts, ends), np.zeros(2, np.uint64)])
            with np.errstate(over="ignore"):
                triple = mix(mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:])
            origin = np.full(batch.num_rows, 2**64 - 1, np.uint64)
            np.minimum.at(origin, owner, triple)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            raw = letters.tobytes()
            words: list[bytes] = []
            rows: list[int] = []
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            begin, end = starts.tolist(), ends.tolist()
            for row in range(batch.num_rows):
                distinct = {edge + raw[begin[i] : end[i]] for i in range(cuts[row], cuts[row + 1])}
                heads = {word[:n] for word in distinct for n in sizes if n <= len(word)}
                heads |= {word + edge for word in distinct if SHORTEST_LANDMARK <= len(word) < LONGEST}
                words += heads
                rows += [row] * len(heads)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(labels[rows], pa.int32()), pa.array(origin.astype(np.int64)[rows])],
                ["word", "label", "origin"],
            )

    return run


def choose_landmarks(rows: DataFrame) -> Landmarks:
    """The word beginnings of the highest likelihood ratio for toxic texts; copies of a text count once."""
    seen = rows.select("text", "label").mapInArrow(
        vocabulary_batches(alphabet()), "word binary, label int, origin bigint"
    )
    counts = seen.distinct().groupBy("word").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")
    )
    share = float(rows.agg(F.avg("label")).first()[0] or 0)
    if not 0 < share < 1:
        return Landmarks([])
    n = F.col("a") + F.col("b")
    clean = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0)
    gain = F.col("a") * F.log(F.col("a") / (n * share)) + clean
    best = (
        counts.where((F.col("a") >= n * PURITY) & (gain >= LEAST_GAIN))
        .orderBy(F.desc(gain), F.desc(F.octet_length("word")), "word")
        .limit(CANDIDATES)
        .select("word")
        .collect()
    )
    candidates = Landmarks([bytes(r["word"]) for r in best])
    own = candidates.gram.diagonal()
    within = candidates.gram / np.maximum(np.minimum(own[:, None], own[None, :]), 1e-300)
    chosen: list[int] = []
    for i in range(len(best)):
        if len(chosen) < LANDMARKS and all(within[i, j] < ALIKE for j in chosen):
            chosen.append(i)
    return Landmarks([candidates.words[i] for i in chosen])


def fit_margin(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine (squared hinge loss, bias last) by Newton-like least squares."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.05
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        active = y * (x @ w) < 1
        xa = x[active]
        new = np.linalg.solve(xa.T @ xa + ridge, xa.T @ y[active])
        if np.allclose(new, w):
            break
        w = new
    return w


def fit_probability(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps."""
    design = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, design.T @ (p - label) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Model:
    """Landmarks, one weight per landmark, the margin of unlike texts and the probability curve."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.slope, self.offset = slope, offset
        self.codes = alphabet()

    def scores(self, column: pa.Array) -> np.ndarray:
        margin = np.full(len(column), self.bias)
        if not self.landmarks.words:
            return np.zeros(len(column))
        rows, found = sentence_features(column, self.landmarks, self.codes)
        np.maximum.at(margin, rows, found @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700)))


def train(rows: DataFrame) -> Model:
    """A model from (doc_id, text, label); only features of the bounded sample reach the driver."""
    rows = stored(rows.select("doc_id", "text", "label"), "toxicity-rows")
    known = {r["doc_id"]: r["label"] for r in rows.select("doc_id", "label").collect()}
    landmarks = choose_landmarks(rows)
    size = len(landmarks.words)
    if not size:
        return Model(landmarks, np.zeros(0), 0.0, 0.0, 0.0)
    kinds = "doc_id bigint, likeness array<double>"
    found = rows.select("doc_id", "text").mapInArrow(feature_batches(landmarks), kinds).distinct().collect()
    ids = list(known)
    at = {doc: i for i, doc in enumerate(ids)}
    # sentences unlike every landmark are all alike; one per text stands for them
    x = np.vstack([np.array([r["likeness"] for r in found]).reshape(-1, size), np.zeros((len(ids), size))])
    owner = np.array([at[r["doc_id"]] for r in found] + list(range(len(ids))))
    label = np.array([known[doc] for doc in ids], float)
    own = np.sqrt(landmarks.gram.diagonal())
    values, vectors = np.linalg.eigh((landmarks.gram / own[:, None] / own[None, :]) ** POWER)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    mapped = x @ root
    margin = x.sum(1)
    weights = np.zeros(size + 1)
    for _ in range(ROUNDS):
        order = np.lexsort((-margin, owner))
        top = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        used = (label[owner] == 0) | (x.max(1) >= PLAIN) | np.isin(np.arange(len(owner)), top)
        weights = fit_margin(mapped[used], np.where(label[owner[used]] == 1, 1.0, -1.0))
        margin = mapped @ weights[:-1] + weights[-1]
    best = np.full(len(ids), -np.inf)
    np.maximum.at(best, owner, margin)
    slope, offset = fit_probability(best, label)
    return Model(landmarks, root @ weights[:-1], float(weights[-1]), slope, offset)


def score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            out = model.value.scores(batch.column("text"))
            yield batch.drop_columns("text").append_column("score", pa.array(out))

    return run


def clean_batches(model, text_col: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, BATCH_BYTES):
            yield batch.filter(pa.array(model.value.scores(batch.column(text_col)) < threshold))

    return run


def fitted(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out_fold: int, train_rows: int
) -> Model:
    usable = id_hash(id_col) % folds != held_out_fold
    return train(sample(df, labels, label_col, usable, train_rows, id_col, text_col))


def score(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 4,
    held_out_fold: int = 2,
    threshold: float = 0.3,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted) for each row; labels of the held-out fold are never learned."""
    model = df.sparkSession.sparkContext.broadcast(
        fitted(df, labels, id_col, text_col, label_col, folds, held_out_fold, train_rows)
    )
    texts = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (id_hash(id_col) % folds == held_out_fold).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    scored = texts.mapInArrow(score_batches(model), "doc_id bigint, held_out boolean, score double")
    return scored.select(
        F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 4,
    held_out_fold: int = 2,
    threshold: float = 0.3,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, all columns as they are; nothing is shuffled."""
    model = df.sparkSession.sparkContext.broadcast(
        fitted(df, labels, id_col, text_col, label_col, folds, held_out_fold, train_rows)
    )

    return df.mapInArrow(clean_batches(model, text_col, threshold), df.schema)
