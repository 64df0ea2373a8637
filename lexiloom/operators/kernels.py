"""Arrow batch kernels: counting over whole batches of texts or token arrays with numpy.

Each kernel reduces its batch to distinct keys, so that only pre-aggregated rows are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lexiloom.shipping import ship

ship(__name__)

DENSE_LIMIT = 1 << 22
# Ids that a kernel works on at once: a dozen arrays of 8 bytes each, whatever the batch holds.
PIECE = 1 << 18


def flat_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes (of strings) or ids (of lists) of a column in one array, and the row lengths."""
    if pa.types.is_list(column.type):
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
    else:
        data = column.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = data.buffers()[2]
        values = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return values[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def pad_rows(
    values: np.ndarray, lengths: np.ndarray, left: int, pad: int, end: int | None, given: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows laid end to end, each after ``left`` pads and before ``end``.

    Returns the flat ids, the position of every target and the row that each target belongs to. The
    first ``given`` ids of a row are no targets.
    """
    right = 0 if end is None else 1
    rows = len(lengths)
    starts = np.cumsum(lengths + left + right) - lengths - right
    flat = np.full(int(lengths.sum()) + rows * (left + right), pad, np.int64)
    before = np.cumsum(lengths) - lengths
    at = np.arange(len(values)) + np.repeat(starts - before, lengths)
    flat[at] = values
    owner = np.repeat(np.arange(rows), lengths)
    if given:
        kept = np.arange(len(values)) - np.repeat(before, lengths) >= given
        at, owner = at[kept], owner[kept]
    if end is not None:
        ends = starts + lengths
        flat[ends] = end
        at, owner = np.concatenate([at, ends]), np.concatenate([owner, np.arange(rows)])
    return flat, at, owner


def bounded_rows(
    values: np.ndarray, lengths: np.ndarray, left: int, pad: int, end: int | None, given: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``pad_rows`` in pieces of at most ``PIECE`` ids; a longer row is cut, each part after the ids before it."""
    ends = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        first = int(ends[row] - lengths[row])
        last = int(np.searchsorted(ends, first + PIECE, side="right"))
        if last > row:
            flat, at, owner = pad_rows(values[first : ends[last - 1]], lengths[row:last], left, pad, end, given)
            yield flat, at, owner + row
            row = last
            continue
        size = int(lengths[row])
        for low in range(0, size, PIECE):
            high = min(size, low + PIECE)
            before = values[first + max(0, low - left) : first + low]
            parts = [np.full(left - len(before), pad, np.int64), before, values[first + low : first + high]]
            if high == size and end is not None:
                parts.append(np.array([end], np.int64))
            flat = np.concatenate(parts).astype(np.int64)
            at = np.arange(left, len(flat))
            at = at[at - left + low >= given]
            yield flat, at, np.full(len(at), row)
        row += 1


def target_shares(lengths: np.ndarray, end: int | None, given: int) -> np.ndarray:
    """One over the number of targets of each row."""
    return 1.0 / np.maximum(np.maximum(lengths - given, 0) + (end is not None), 1)


def packed(flat: np.ndarray, at: np.ndarray, order: int, base: int) -> np.ndarray:
    """The ``order`` ids up to and including each position, as one number in base ``base``."""
    code = flat[at].copy()
    for back in range(1, order):
        code += flat[at - back] * base**back
    return code


def tally(codes: np.ndarray, size: int, weights: np.ndarray):
    """Distinct codes with their counts and summed weights."""
    # an array of all codes only where it is no larger than a few arrays of the codes given
    if size <= min(DENSE_LIMIT, max(4 * len(codes), 1 << 16)):
        n, w = np.bincount(codes), np.bincount(codes, weights)
        seen = np.flatnonzero(n)
        return seen, n[seen], w[seen]
    seen, inverse, n = np.unique(codes, return_inverse=True, return_counts=True)
    return seen, n, np.bincount(inverse, weights)


def ngram_batches(orders: list[int], base: int, pad: int, end: int | None, given: int):
    """(model_order, context, next, n, w): n-grams per batch.

    A target adds 1 to ``n`` and one over the number of targets of its row to ``w``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = flat_values(batch.column(0))
            share = target_shares(lengths, end, given)
            for flat, at, owner in bounded_rows(values, lengths, max(orders) - 1, pad, end, given):
                weights = share[owner]
                for order in orders:
                    codes, n, w = tally(packed(flat, at, order, base), base**order, weights)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(codes), order, np.int32)),
                            pa.array(codes // base),
                            pa.array((codes % base).astype(np.int32)),
                            pa.array(n.astype(np.int64)),
                            pa.array(w),
                        ],
                        ["model_order", "context", "next", "n", "w"],
                    )

    return run


def example_ngram_batches(order: int, base: int, pad: int, end: int | None, given: int):
    """(id, context, next, n): n-grams per example; the first column holds the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = flat_values(batch.column(1))
            for flat, at, owner in bounded_rows(values, lengths, order - 1, pad, end, given):
                codes = packed(flat, at, order, base)
                seen = None
                size = base**order
                if len(lengths) * size >= 1 << 62:
                    # number the codes of the piece, so that row and code fit one key
                    seen, codes = np.unique(codes, return_inverse=True)
                    size = len(seen)
                keys, n = np.unique(owner * size + codes, return_counts=True)
                codes = keys % size if seen is None else seen[keys % size]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keys // size)),
                        pa.array(codes // base),
                        pa.array((codes % base).astype(np.int32)),
                        pa.array(n.astype(np.int64)),
                    ],
                    ["id", "context", "next", "n"],
                )

    return run


def byte_count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, byte, n): byte counts per value of the first column; the second holds the text."""
    for batch in batches:
        groups = batch.column(0).dictionary_encode()
        values, lengths = flat_values(batch.column(1))
        owner = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        counts = np.zeros(len(groups.dictionary) * 256, np.int64)
        for low in range(0, len(values), PIECE):
            piece = values[low : low + PIECE]
            row = np.searchsorted(ends, np.arange(low, low + len(piece)), side="right")
            counts += np.bincount(owner[row] * 256 + piece, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                groups.dictionary.take(pa.array(seen // 256)),
                pa.array((seen % 256).astype(np.int32)),
                pa.array(counts[seen]),
            ],
            ["grp", "byte", "n"],
        )


class ContextModel:
    """Cumulative entries of all orders: per order the sorted contexts, and where each one's entries begin.

    Without the entries' own orders and contexts, that is 12 bytes an entry and 16 a context.
    """

    def __init__(self, entries: pa.Table):
        orders, contexts = (entries.column(c).to_numpy() for c in ("model_order", "context"))
        self.hi, self.next = entries.column("hi").to_numpy(), entries.column("next").to_numpy()
        self.by_order = {}
        new = np.ones(len(orders), bool)
        new[1:] = (orders[1:] != orders[:-1]) | (contexts[1:] != contexts[:-1])
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(orders))
        for k in np.unique(orders).tolist():
            own = orders[begins] == k
            self.by_order[k] = (contexts[begins[own]], begins[own].astype(np.int32), ends[own].astype(np.int32))

    def longest(self, full: np.ndarray, order: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of the entries of each row's longest suffix that is there, and its order."""
        begin, end, found = (np.zeros(len(full), np.int64) for _ in range(3))
        for k in range(order, 0, -1):
            contexts, begins, ends = self.by_order.get(k, (np.empty(0, np.int64),) * 3)
            rows = np.flatnonzero(found == 0)
            if not len(contexts) or not len(rows):
                continue
            sought = full[rows] % base ** (k - 1)
            at = np.minimum(np.searchsorted(contexts, sought), len(contexts) - 1)
            rows, at = rows[contexts[at] == sought], at[contexts[at] == sought]
            begin[rows], end[rows], found[rows] = begins[at], ends[at], k
        return begin, end, found

    def pick(self, begin: np.ndarray, end: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The token of the first entry above each row's place, by halving all ranges at once."""
        low, high = begin.copy(), end - 1
        while (open_ := low < high).any():
            middle = (low + high) // 2
            above = self.hi[middle] > places
            high = np.where(open_ & above, middle, high)
            low = np.where(open_ & ~above, middle + 1, low)
        return self.next[low]


def drawn_places(names: list[str], steps: list[int], totals: list, whole: bool, seed: int | str) -> list:
    """Where each row's draw falls, as ``place_in`` says."""
    places = []
    for name, step, total in zip(names, steps, totals):
        digest = hashlib.md5(f"{seed}:{name}:{step}".encode()).hexdigest()
        if whole:
            places.append(int(digest[: 8 if total <= 1 << 24 else 15], 16) % total)
        else:
            places.append(int(digest[:13], 16) / float(1 << 52) * total)
    return places


@dataclass(frozen=True)
class Continuer:
    """Continues rows by ``model``, which holds all contexts or, if ``partial``, some of each length and the empty one."""

    model: ContextModel
    order: int
    base: int
    stop: int | None
    end_tag: list[int]
    seed: int | str
    whole: bool
    partial: bool = False

    def run(self, names: list[str], full, budget, size, last: list[list[int]], given, asked):
        """Tokens, ends and orders: what rows say until they end or, in a partial model, the longest context is unknown.

        ``full``, ``size`` and ``last`` (as many tokens as the end tag has) are brought up to date. The first token
        of a row is ``given`` or, where it is below 0 and other tables were ``asked`` in vain, of the longest context here.
        """
        tag = self.end_tag
        out: list[list[int]] = [[] for _ in names]
        done = size >= budget
        orders = np.zeros(len(names), np.int32)
        active = np.flatnonzero(~done)
        settled = asked | (given >= 0)
        while len(active):
            begin, end, found = self.model.longest(full[active], self.order, self.base)
            if self.partial:
                goes_on = (found == self.order) | settled[active]
                orders[active[~goes_on]] = found[~goes_on]
                active, begin, end = active[goes_on], begin[goes_on], end[goes_on]
                if not len(active):
                    break
            totals = self.model.hi[end - 1].tolist()
            places = drawn_places([names[i] for i in active], size[active].tolist(), totals, self.whole, self.seed)
            tokens = self.model.pick(begin, end, np.array(places, self.model.hi.dtype))
            tokens = np.where(given[active] >= 0, given[active], tokens)
            settled[active], given[active] = False, -1
            full[active] = (full[active] * self.base + tokens) % self.base ** (self.order - 1)
            ended = tokens == self.stop if self.stop is not None else np.zeros(len(tokens), bool)
            size[active[~ended]] += 1
            for j, (i, token) in enumerate(zip(active.tolist(), tokens.tolist())):
                if ended[j]:
                    continue
                out[i].append(token)
                if tag and token == tag[-1] and (last[i] + out[i][-len(tag) :])[-len(tag) :] == tag:
                    size[i] -= len(tag)
                    ended[j] = True
            ended |= size[active] >= budget[active]
            done[active[ended]] = True
            active = active[~ended]
        if tag:
            last[:] = [(a + b)[-len(tag) :] for a, b in zip(last, out)]
        return out, done, orders


def continue_batches(rows: Continuer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, out): rows of (key, name, full, budget) continued token by token, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            full = batch.column("full").to_numpy().copy()
            budget = batch.column("budget").to_numpy(zero_copy_only=False)
            size = np.zeros(len(names), np.int64)
            given, asked = np.full(len(names), -1), np.zeros(len(names), bool)
            out, _, _ = rows.run(names, full, budget, size, [[] for _ in names], given, asked)
            out = [tokens[:n] for tokens, n in zip(out, size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "out"])

    return run


STATE = "row bigint, key {kind}, full bigint, out array<int>, last array<int>, size int, budget int, done boolean, known int"


def advance_batches(rows: Continuer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``STATE``: rows of (row, key, name, full, last, size, budget, given, asked) continued as far as a partial model goes.

    ``known`` is the order of the longest context that it has of a row that stopped for a longer one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            full, given = (column[n].to_numpy().copy() for n in ("full", "given"))
            size = column["size"].to_numpy().astype(np.int64)
            budget, asked = (column[n].to_numpy(zero_copy_only=False) for n in ("budget", "asked"))
            last = column["last"].to_pylist()
            out, done, known = rows.run(column["name"].to_pylist(), full, budget, size, last, given, asked)
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (out, last)]
            yield pa.RecordBatch.from_arrays(
                [column["row"], column["key"], pa.array(full), *lists, pa.array(size.astype(np.int32)), column["budget"], pa.array(done), pa.array(known)],
                ["row", "key", "full", "out", "last", "size", "budget", "done", "known"],
            )

    return run


def next_token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, next_token, n) of a batch of two list columns of equal lengths: inputs and targets."""
    for batch in batches:
        inputs, targets = (
            c.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns
        )
        keys, n = np.unique(inputs << 32 | targets, return_counts=True)
        columns = [(keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), n.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "next_token", "n"])
