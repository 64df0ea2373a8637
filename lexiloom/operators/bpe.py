"""Byte-level byte-pair encoding: learning on a distributed word table, encoding and decoding.

Learning holds the words of an Arrow batch as one block: all their ids end to end, their lengths and their counts.
Encoding holds a word as a string with one supplementary code point per symbol, so a merge is a native
``replace`` (leftmost, non-overlapping) and code-point order is id order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import utf8
from lexiloom.operators.kernels import flat_values
from lexiloom.session import cut_lineage
from lexiloom.shipping import ship
from lexiloom.sources.metadata import SPECIAL_TOKENS
from lexiloom.sources.tables import needs_spread, spread

ship(__name__)

# The published byte-level split pattern, with its whitespace class spelled out.
SPACE = r"\t-\r\x85\p{Z}"
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
MIN_FREQUENCY = 2

SYMBOL_BASE = 0x20000
TOP_PAIRS = 64
ROUNDS_PER_CUT = 16
# Pairs that are counted in an array of all of them, rather than by sorting.
DENSE_PAIRS = 1 << 22
BLOCKS = "ids binary, sizes binary, n binary"
MEMO_WORDS = 1 << 17
# Words of a batch that are spelled at once.
WORDS_PER_STEP = 1 << 17
# Longer words are segmented with a heap and not remembered.
LONG_WORD = 64


def byte_order() -> list[int]:
    """Byte values in the order of the byte-level alphabet: printable ones first."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return printable + [b for b in range(256) if b not in set(printable)]


def symbol(token_id: int) -> str:
    return chr(SYMBOL_BASE + token_id)


def initial_symbols() -> str:
    """The symbol of each byte value, in byte order."""
    rank = {b: i for i, b in enumerate(byte_order())}
    return "".join(symbol(len(SPECIAL_TOKENS) + rank[b]) for b in range(256))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPLIT_PATTERN), F.lit(0))


def encode_pretokens(text: Column) -> Column:
    """Pre-tokens of a text whose special tokens stand for themselves."""
    quoted = "|".join(rf"\Q{t}\E" for t in SPECIAL_TOKENS)
    parts = F.split(text, f"(?<={quoted})|(?={quoted})")
    return F.flatten(
        F.transform(
            F.filter(parts, lambda p: p != ""),
            lambda p: F.when(p.isin(SPECIAL_TOKENS), F.array(p)).otherwise(pretokens(p)),
        )
    )


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the only pass over the corpus that learning needs."""
    return (
        docs.select(F.explode(pretokens(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def word_symbols(word: Column) -> Column:
    latin = F.decode(utf8(word), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, range(256))), initial_symbols())


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, n): adjacent symbols, weighted by the count of their word."""
    adjacent = "zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> concat(a, b))"
    return (
        words.where("length(word) > 1")
        .selectExpr("split(word, '') AS c", "n")
        .selectExpr(f"explode({adjacent}) AS pair", "n")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


def _block(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = (np.int32, np.int32, np.int64)
    data = [pa.array([c.astype(kind).tobytes()], pa.binary()) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(data, ["ids", "sizes", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, lengths and counts of the words of each block."""
    for batch in batches:
        for ids, sizes, n in zip(*(batch.column(i) for i in range(3))):
            yield (
                np.frombuffer(ids.as_buffer(), np.int32),
                np.frombuffer(sizes.as_buffer(), np.int32),
                np.frombuffer(n.as_buffer(), np.int64),
            )


def _joints(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each id but the last is followed by one of its own word."""
    inside = np.ones(max(len(ids) - 1, 0), bool)
    inside[np.cumsum(sizes)[:-1] - 1] = False
    return inside


def word_blocks(words: DataFrame) -> DataFrame:
    """The words (word, n) of two or more bytes as blocks of ids."""
    first_ids = np.empty(256, np.int32)
    first_ids[byte_order()] = len(SPECIAL_TOKENS) + np.arange(256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = flat_values(batch.column(0))
            long = sizes > 1
            yield _block(first_ids[values][np.repeat(long, sizes)], sizes[long], batch.column(1).to_numpy()[long])

    return words.select("word", "n").mapInArrow(run, BLOCKS)


def block_pairs(blocks: DataFrame, base: int) -> DataFrame:
    """(left, right, n): adjacent ids, all below ``base``, weighted by the count of their word."""

    def table(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [(codes // base).astype(np.int32), (codes % base).astype(np.int32), n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["left", "right", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(base**2 if base**2 <= DENSE_PAIRS else 0)
        for ids, sizes, n in _blocks(batches):
            inside = _joints(ids, sizes)
            codes = (ids[:-1].astype(np.int64) * base + ids[1:])[inside]
            weights = np.repeat(n, sizes)[:-1][inside]
            if len(total):
                total += np.bincount(codes, weights, len(total))
            elif len(codes):
                order = np.argsort(codes)
                seen, at = np.unique(codes[order], return_index=True)
                yield table(seen, np.add.reduceat(weights[order], at))
        if len(total):
            seen = np.flatnonzero(total)
            yield table(seen, total[seen])

    counted = blocks.mapInArrow(run, "left int, right int, n bigint")
    return counted.groupBy("left", "right").agg(F.sum("n").alias("n"))


def merge_ids(
    ids: np.ndarray, sizes: np.ndarray, merges: list[tuple[int, int, int, int]]
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of words after a batch of merges, which is one of :func:`_next_batch`.

    No two pairs of a batch overlap; a pair of equal ids overlaps itself in runs, and every second place counts.
    """
    pairs = np.array([m[:3] for m in merges], np.int64)
    base = int(max(ids.max(initial=0), pairs[:, :2].max())) + 1
    starts, ends = np.zeros(base, bool), np.zeros(base, bool)
    starts[pairs[:, 0]], ends[pairs[:, 1]] = True, True
    hits = np.flatnonzero(starts[ids[:-1]] & ends[ids[1:]] & _joints(ids, sizes))
    codes = pairs[:, 0] * base + pairs[:, 1]
    order = np.argsort(codes)
    sought = ids[hits].astype(np.int64) * base + ids[hits + 1]
    at = order[np.minimum(np.searchsorted(codes[order], sought), len(order) - 1)]
    found = codes[at] == sought
    hits, at = hits[found], at[found]
    place = np.arange(len(hits))
    runs = np.append(True, np.diff(hits) != 1)[: len(hits)]
    taken = (place - np.maximum.accumulate(np.where(runs, place, 0))) % 2 == 0
    hits, at = hits[taken], at[taken]
    owner = np.searchsorted(np.cumsum(sizes), hits, side="right")
    out, kept = ids.copy(), np.ones(len(ids), bool)
    out[hits], kept[hits + 1] = pairs[at, 2], False
    return out[kept], sizes - np.bincount(owner, minlength=len(sizes)).astype(sizes.dtype)


def merge_blocks(blocks: DataFrame, merges: list[tuple[int, int, int, int]]) -> DataFrame:
    """Apply a batch of merges; words of which one id is left have no pair any more and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, n in _blocks(batches):
            ids, sizes = merge_ids(ids, sizes, merges)
            long = sizes > 1
            yield _block(ids[np.repeat(long, sizes)], sizes[long], n[long])

    return blocks.mapInArrow(run, BLOCKS)


def _next_batch(
    ranked: Iterable[tuple[int, int, int]], vocab: list[bytes], known: dict[bytes, int], room: int
) -> list[tuple[int, int, int, int]]:
    """The longest prefix of the ranked pairs that one-at-a-time learning would merge unchanged.

    Merging (a, b) leaves the count of (c, d) alone unless d is a or c is b, and a pair with the
    new symbol can be no more frequent than (x, a) or (b, y), which conflict with (a, b) in just
    that way and so end the prefix before anything ranked after them. A pair of equal symbols, or
    one that spells a token already known, is merged as the last of its batch.
    """
    batch, lefts, rights = [], set(), set()
    for left, right, n in ranked:
        if left in rights or right in lefts or room == 0:
            break
        spelled = vocab[left] + vocab[right]
        seen = spelled in known
        if not seen:
            known[spelled] = len(vocab)
            vocab.append(spelled)
            room -= 1
        batch.append((left, right, known[spelled], n))
        if seen or left == right:
            break
        lefts.add(left)
        rights.add(right)
    return batch


@dataclass(frozen=True)
class Tokenizer:
    """Ordered merges (left, right, new, frequency) and the bytes of each token id."""

    merges: list[tuple[int, int, int, int]]
    vocab: list[bytes]
    _ranks: dict[str, tuple[int, str]] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        ranks: dict[str, tuple[int, str]] = {}
        for rank, (left, right, new, _) in enumerate(self.merges):
            ranks.setdefault(symbol(left) + symbol(right), (rank, symbol(new)))
        object.__setattr__(self, "_ranks", ranks)

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    def merges_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, *merge) for rank, merge in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int, n bigint")

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, b, i < len(SPECIAL_TOKENS)) for i, b in enumerate(self.vocab)]
        return spark.createDataFrame(rows, "token_id int, bytes binary, special boolean")

    def save(self, spark: SparkSession, path: str) -> None:
        self.merges_table(spark).coalesce(1).write.parquet(f"{path}/merges")
        self.vocab_table(spark).coalesce(1).write.parquet(f"{path}/vocab")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
        vocab = spark.read.parquet(f"{path}/vocab").orderBy("token_id").collect()
        return cls([tuple(r)[1:] for r in merges], [bytes(r["bytes"]) for r in vocab])

    def encode(self, docs: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
        """Add the token ids of a text. Map-only: the merges travel with the tasks."""
        udf = _encoder(self._ranks)
        return docs.withColumn(name, udf(encode_pretokens(F.coalesce(F.col(text), F.lit("")))))

    def decode(
        self, docs: DataFrame, tokens: str = "tokens", name: str = "text", skip_special: bool = True
    ) -> DataFrame:
        """Add the text of token ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.vocab_table(docs.sparkSession)
        spelled = F.when(F.col("special") & F.lit(skip_special), "").otherwise(F.hex("bytes"))
        ordered = F.array_sort(F.collect_list(F.struct("token_id", spelled.alias("h"))))
        hexes = table.agg(F.transform(ordered, lambda e: e["h"]).alias("hexes")).scalar()
        return (
            docs.withColumn("_hexes", hexes)
            .withColumn(
                "_hex", F.array_join(F.transform(F.col(tokens), lambda t: F.get(F.col("_hexes"), t)), "")
            )
            .withColumn(name, F.make_valid_utf8(F.unhex("_hex").cast("string")))
            .drop("_hexes", "_hex")
        )


def segment_long(word: str, ranks: dict[str, tuple[int, str]]) -> str:
    """``segment`` in n log n: neighbours in a linked list, candidate merges in a heap by rank and place."""
    parts: list[str | None] = list(word)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, str, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (merge := ranks.get(parts[i] + parts[j])):
            heapq.heappush(heap, (merge[0], i, parts[i] + parts[j], merge[1]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, pair, merged = heapq.heappop(heap)
        j = after[i]
        # a stale candidate: one of its two symbols was merged away meanwhile
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = merged, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return "".join(p for p in parts if p is not None)


def segment(word: str, ranks: dict[str, tuple[int, str]]) -> str:
    """Apply the earliest learned merge that fits, everywhere in the word, until none fits."""
    if len(word) > LONG_WORD:
        return segment_long(word, ranks)
    while len(word) > 1:
        pairs = {a + b for a, b in zip(word, word[1:])}
        best = min((ranks[p] + (p,) for p in pairs if p in ranks), default=None)
        if best is None:
            break
        word = word.replace(best[2], best[1])
    return word


def _encoder(ranks: dict[str, tuple[int, str]]):
    symbols = initial_symbols()
    special = {t: [i] for i, t in enumerate(SPECIAL_TOKENS)}
    memo: dict[str, list[int]] = {}

    def ids_of(word: str) -> list[int]:
        if word in special:
            return special[word]
        ids = memo.get(word)
        if ids is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            start = "".join([symbols[b] for b in word.encode()])
            ids = [ord(s) - SYMBOL_BASE for s in segment(start, ranks)]
            if len(start) <= LONG_WORD:
                memo[word] = ids
        return ids

    @F.arrow_udf("array<int>")
    def encode(words: pa.Array) -> pa.Array:
        offsets = words.offsets.to_numpy()
        flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
        ids, counts = [np.empty(0, np.int32)], np.zeros(len(flat) + 1, np.int64)
        # a step at a time, so that a batch of long texts needs little besides its ids
        for low in range(0, len(flat), WORDS_PER_STEP):
            step = flat.slice(low, WORDS_PER_STEP).dictionary_encode()
            spelled = [ids_of(w) for w in step.dictionary.to_pylist()]
            sizes = np.array([len(s) for s in spelled], np.int64)
            pool = np.fromiter((i for s in spelled for i in s), np.int32, int(sizes.sum()))
            index = step.indices.to_numpy(zero_copy_only=False)
            n = sizes[index]
            begin = (np.cumsum(sizes) - sizes)[index]
            ids.append(pool[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            counts[low + 1 : low + 1 + len(n)] = n
        bounds = np.cumsum(counts)[offsets - offsets[0]]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(ids)))

    return encode


def learn(
    docs: DataFrame, text: str, vocab_size: int, min_frequency: int = MIN_FREQUENCY
) -> Tokenizer:
    """Learn merges until the vocabulary has ``vocab_size`` entries or no pair is frequent enough.

    Equal counts are ordered by left id, then right id. The word table stays distributed; only the
    most frequent pairs of a round reach the driver.
    """
    if vocab_size < len(SPECIAL_TOKENS):
        raise ValueError("vocab_size is too small for the special tokens")
    vocab = [t.encode() for t in SPECIAL_TOKENS] + [bytes([b]) for b in byte_order()]
    known = {b: i for i, b in enumerate(vocab)}
    merges: list[tuple[int, int, int, int]] = []
    words = cut_lineage(pretoken_counts(docs, text).where(F.octet_length("word") > 1))
    if needs_spread(words):
        words = spread(words, "word")
    blocks = cut_lineage(word_blocks(words))
    rounds, previous = 0, None
    while len(vocab) < vocab_size:
        top = (
            block_pairs(blocks, len(vocab))
            .where(f"n >= {min_frequency}")
            .orderBy(F.desc("n"), "left", "right")
            .limit(TOP_PAIRS)
            .collect()
        )
        # counting has filled the cache of ``blocks``; the table before it is no longer needed
        if previous is not None:
            previous.unpersist()
        ranked = [(r["left"], r["right"], r["n"]) for r in top]
        batch = _next_batch(ranked, vocab, known, vocab_size - len(vocab))
        if not batch:
            break
        merges += batch
        rounds += 1
        previous, blocks = blocks, merge_blocks(blocks, batch)
        if rounds % ROUNDS_PER_CUT == 0:
            blocks = cut_lineage(blocks)
        else:
            blocks = blocks.persist()
    for table in (previous, blocks):
        if table is not None:
            table.unpersist()
    return Tokenizer(merges, vocab)
