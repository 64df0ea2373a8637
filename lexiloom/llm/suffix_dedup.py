"""Removal of long repeated byte strings by external induced sorting of suffixes.

Every position of a text at which ``LENGTH`` bytes fit is a suffix of that length. The least hash of the
``GRAM``-byte strings in it is its anchor; equal suffixes have equal anchors at equal places, so anchors cut
the suffixes of the corpus into shards, and an anchor that occurs once proves that none of its suffixes
repeats. Neighbouring suffixes of one anchor form a record, about 69 suffixes in 270 bytes. Periodic text, where
anchors recur at equal distances, is found as it is: each of its suffixes equals the one a period further, and
only those of its first period become records, for others to be compared with.

A shard's records are sorted by Spark, which spills to disk, and streamed through induction: the suffixes at
the anchors are sorted first, with the common prefix of each pair of neighbours; then the order of the
suffixes that start a byte earlier is induced from theirs, byte by byte to the left: (byte, rank) tuples in
a stable order, common-prefix values carried along as minima over the ranks between. Neighbours whose common
prefix reaches ``LENGTH`` are repeated. Memory holds the shards of one batch, whatever their number.

Equal texts are found before by a checksum and keep one representative; all their suffixes repeat. Shards of
over ``HOT`` records, such as those of a passage that is in a large part of all texts, are not sorted by one
task: suffixes that repeat within a task's batch are settled there, and the others, dealt to ``PARTS`` parts
by their 128-bit hash, meet their equals from other batches in packed form.

Defined results: null counts as empty; texts shorter than ``LENGTH`` lose nothing; rows that share id and text
count as two texts, so they repeat each other; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices, stored, text_bytes, text_or_empty
from lexiloom.llm.splitting import BASE, mix
from lexiloom.shipping import ship

ship(__name__)

GRAM = 64
LENGTH = 200
HOT = 4096
#: Keys that the records of one anchor are spread over while its repetitions are looked up.
SALTS = 16
PARTS = 512
#: Text bytes that anchors are found in at once, and those that a kernel takes from a batch.
SECTION = 1 << 17
SLICE = 1 << 20
PLACE_BITS = 18
#: Records whose suffixes are sorted together; a shard is never split.
CHUNK = 1 << 14
#: Records whose bytes are cut from their texts together.
CUT = 1 << 12

ANCHORS = "h bigint, k1 bigint, k2 bigint, first int, n int, place int, end int"
SPANS = "k1 bigint, k2 bigint, start int, end int"
RECORDS = "h bigint, hot boolean, k1 bigint, k2 bigint, first int, n int, place int, bytes binary"
RESULTS = "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


class Hasher:
    """Hashes of all windows of a size in a piece of bytes."""

    def __init__(self):
        self.powers = self.backs = np.ones(1, np.uint64)

    def windows(self, data: np.ndarray, size: int, salt: int = 1) -> np.ndarray:
        n = len(data)
        with np.errstate(over="ignore"):
            if len(self.powers) < n + 1:
                inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
                one = np.ones(1, np.uint64)
                self.powers = np.multiply.accumulate(np.append(one, np.full(n, BASE, np.uint64)))
                self.backs = np.multiply.accumulate(np.append(one, np.full(n, inverse, np.uint64)))
            table = mix(np.arange(256, dtype=np.uint64) + np.uint64(256 * salt))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[data] * self.powers[:n], out=sums[1:])
            return mix((sums[size:] - sums[: n + 1 - size]) * self.backs[: n + 1 - size])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from running minima of blocks to both sides."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def periodic_zones(piece: np.ndarray, starts: np.ndarray, n: np.ndarray, at: np.ndarray, grams: np.ndarray, row: np.ndarray):
    """Zones of periodic text among the records of a piece: (row, start, end) of each, and the records to keep.

    Anchors of one hash at equal distances hint at a period, which is then verified on the bytes. A suffix of
    a zone equals the one a period further or before, so the zone is covered as a whole, and the suffixes of its
    first period are enough for others to be compared with.
    """
    step = np.diff(at)
    alike = (row[1:] == row[:-1]) & (grams[at[1:]] == grams[at[:-1]]) & (starts[1:] == starts[:-1] + n[:-1])
    goes_on = np.zeros(len(alike) + 1, bool)
    goes_on[1:-1] = alike[1:] & alike[:-1] & (step[1:] == step[:-1])
    # chains of equal steps, from the record where one opens to the one where the next step differs
    opens = np.flatnonzero(alike & ~goes_on[:-1])
    breaks = np.flatnonzero(~goes_on)
    closes = breaks[np.searchsorted(breaks, opens, side="right")]
    long = (step[opens] > 0) & (at[closes] + GRAM - at[opens] >= LENGTH + 2 * step[opens])
    keep = np.ones(len(at), bool)
    zones = []
    for o, e in zip(opens[long], closes[long]):
        low, high, period = int(at[o]), int(at[e]) + GRAM, int(step[o])
        if (piece[low + period : high] != piece[low : high - period]).any():
            continue
        # as far as the bytes of these records go on alike to both sides
        first, last = int(starts[o]), int(starts[e] + n[e]) - 1 + LENGTH
        before = np.flatnonzero(piece[first:low] != piece[first + period : low + period])
        low = first + int(before[-1]) + 1 if len(before) else first
        after = np.flatnonzero(piece[high:last] != piece[high - period : last - period])
        high = high + int(after[0]) if len(after) else last
        zones.append((int(row[o]), low, high))
        inside = slice(o, e + 1)
        keep[inside] &= ~((starts[inside] >= low + period) & (starts[inside] + n[inside] - 1 <= high - LENGTH))
    return zones, keep


def anchor_runs(data: np.ndarray, offsets: np.ndarray, hasher: Hasher):
    """(anchor hash, row, first, n, place, end) of the records of all rows, and of zones of periodic text.

    ``first`` is the first of ``n`` suffixes in the row, ``place`` the anchor's distance from it, ``end`` 0. A
    zone has its bounds as ``first`` and ``end``.
    """
    found = []
    fits = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    marks = np.zeros(len(data) + 1, np.int32)
    np.add.at(marks, offsets[:-1], 1)
    np.add.at(marks, fits, -1)
    valid = np.cumsum(marks[:-1], dtype=np.int32) > 0
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for low in range(0, max(len(data) - LENGTH + 1, 0), SECTION):
        piece = data[low : low + SECTION + LENGTH - 1]
        grams = hasher.windows(piece, GRAM)
        keyed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_least(keyed, LENGTH - GRAM + 1) & mask).astype(np.int64)
        inside = valid[low : low + len(anchor)]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        n = np.add.reduceat(inside.astype(np.int64), starts)
        row = np.searchsorted(offsets, starts + low, side="right") - 1
        zones, keep = periodic_zones(piece, starts, n, anchor[starts], grams, row)
        starts, n, row = starts[keep], n[keep], row[keep]
        none = np.zeros(len(starts), np.int64)
        found.append(
            (grams[anchor[starts]].astype(np.int64), row, starts + low - offsets[row], n, anchor[starts] - starts, none)
        )
        if zones:
            row, start, end = np.array(zones).T
            none = np.zeros(len(zones), np.int64)
            found.append((none, row, start + low - offsets[row], none, none, end + low - offsets[row]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none,) * 6


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of unique texts, without their bytes, and their zones."""
    hasher = Hasher()
    for batch in slices(batches, "text", SLICE):
        data, offsets = text_bytes(batch.column("text"))
        h, row, first, n, place, end = anchor_runs(data, offsets, hasher)
        rows = pa.array(row)
        columns = [pa.array(h), batch.column("k1").take(rows), batch.column("k2").take(rows)]
        columns += [pa.array(c.astype(np.int32)) for c in (first, n, place, end)]
        yield pa.RecordBatch.from_arrays(columns, ["h", "k1", "k2", "first", "n", "place", "end"])


def record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with their bytes, from texts with their lists of repeated anchors."""
    for batch in slices(batches, "text", SLICE):
        data, offsets = text_bytes(batch.column("text"))
        lists = batch.column("records")
        sizes = np.diff(lists.offsets.to_numpy())
        entries = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), sizes)
        first, n = (entries.field(c).to_numpy().astype(np.int64) for c in ("first", "n"))
        lengths = n + LENGTH - 1
        for low in range(0, len(row), CUT):
            part = slice(low, low + CUT)
            size = lengths[part]
            upto = np.cumsum(size)
            at = np.arange(int(upto[-1])) + np.repeat(offsets[row[part]] + first[part] - (upto - size), size)
            cut = np.zeros(len(size) + 1, np.int32)
            cut[1:] = upto
            held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(data[at])])
            rows = pa.array(row[part])
            chosen = entries.slice(low, CUT)
            yield pa.RecordBatch.from_arrays(
                [
                    chosen.field("h"),
                    chosen.field("hot"),
                    batch.column("k1").take(rows),
                    batch.column("k2").take(rows),
                    *(chosen.field(c) for c in ("first", "n", "place")),
                    held,
                ],
                ["h", "hot", "k1", "k2", "first", "n", "place", "bytes"],
            )


def least_between(values: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """For each picked rank, the least value after the picked rank before up to it; the first has none (0)."""
    out = np.zeros(len(picked), values.dtype)
    if len(picked) > 1:
        out[1:] = np.minimum.reduceat(values[: picked[-1] + 1], picked[:-1] + 1)
    return out


def induce(h: np.ndarray, data: np.ndarray, begin: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, suffix) of all suffixes that are equal to another one in their shard.

    Record ``r`` holds the bytes from ``begin[r]`` on of ``n[r]`` suffixes, its anchor at ``place[r]``; ``h`` is
    the shard. Suffix ``place - back`` starts ``back`` bytes before the anchor.
    """
    size = n + LENGTH - 1
    nearest = place - n + 1
    column = np.arange(LENGTH)
    right = np.zeros((len(h), LENGTH), np.uint8)
    there = column[None, :] < (size - place)[:, None]
    flat = (begin + place)[:, None] + column[None, :]
    right[there] = data[flat[there]]
    words = right.view(">u8").astype(np.uint64)
    _, shard = np.unique(h, return_inverse=True)
    order = np.lexsort((*words.T[::-1], shard))
    same_shard = shard[order][1:] == shard[order][:-1]
    differs = right[order[1:]] != right[order[:-1]]
    common = np.zeros(len(h), np.int32)
    common[1:] = np.where(differs.any(1), differs.argmax(1), LENGTH)
    common[1:][~same_shard] = -LENGTH
    if len(h):
        common[0] = -LENGTH
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for back in range(int(place.max(initial=-1)) + 1):
        if back:
            # the suffixes one byte earlier: those that have it, in the order of (shard, byte, rank)
            kept = np.flatnonzero(place[order] >= back)
            if len(kept) < len(order):
                common, order = least_between(common, kept), order[kept]
                if len(order):
                    common[0] = -LENGTH
            if not len(order):
                break
            byte = data[begin[order] + place[order] - back]
            key = shard[order] * 256 + byte
            moved = np.argsort(key, kind="stable")
            key = key[moved]
            shorter = np.full(len(order), 0, np.int32)
            together = np.flatnonzero(key[1:] == key[:-1])
            if len(together):
                low, high = moved[together] + 1, moved[together + 1] + 1
                pairs = np.stack([low, np.minimum(high, len(common) - 1)], 1).reshape(-1)
                least = np.minimum.reduceat(common, pairs)[::2]
                # a range up to the last rank is cut above; its last value counts as well
                least = np.where(high == len(common), np.minimum(least, common[-1]), least)
                shorter[together + 1] = least + 1
            other = np.ones(len(order), bool)
            order = order[moved]
            other[1:] = shard[order][1:] != shard[order][:-1]
            shorter[other] = -LENGTH
            common = shorter
        held = np.flatnonzero(nearest[order] <= back)
        if len(held) > 1:
            equal = least_between(common, held) >= LENGTH
            equal[0] = False
            both = equal.copy()
            both[:-1] |= equal[1:]
            record = order[held[both]]
            found.append((record, place[record] - back))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none)


def span_rows(k1: np.ndarray, k2: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """(k1, k2, start, end): maximal runs of repeated suffixes, as the bytes that they cover."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start = k1[order], k2[order], start[order]
    new = np.ones(len(start), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    columns = [pa.array(k1[first]), pa.array(k2[first])]
    columns += [pa.array(c.astype(np.int32)) for c in (start[first], start[last] + LENGTH)]
    return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "start", "end"])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data = column.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)), offsets[:-1]


def whole_shards(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches regrouped into ones of about ``CHUNK`` rows that split no key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(low, CHUNK))
            rows += held[-1].num_rows
            if rows < CHUNK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield whole.slice(0, cut)
            held, rows = [whole.slice(cut)], whole.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated suffixes of records that come sorted by shard."""
    for batch in whole_shards(batches, "h"):
        data, begin = binary_parts(batch.column("bytes"))
        h, k1, k2 = (batch.column(c).to_numpy() for c in ("h", "k1", "k2"))
        first, n, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "n", "place"))
        record, suffix = induce(h, data, begin, n, place)
        yield span_rows(k1[record], k2[record], first[record] + suffix)


def hot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed suffix hashes of hot shards by part; the suffixes that repeat here come as finished spans."""
    hasher = Hasher()
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK // 4):
            piece = batch.slice(low, CHUNK // 4)
            data, begin = binary_parts(piece.column("bytes"))
            n, first = (piece.column(c).to_numpy().astype(np.int64) for c in ("n", "first"))
            record = np.repeat(np.arange(len(n)), n)
            suffix = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
            base = int(begin[0])
            whole = data[base : int(begin[-1] + n[-1] + LENGTH - 1)]
            at = begin[record] - base + suffix
            entry = np.zeros((len(at), 5), np.int64)
            entry[:, 0] = hasher.windows(whole, LENGTH, 1)[at].astype(np.int64)
            entry[:, 1] = hasher.windows(whole, LENGTH, 2)[at].astype(np.int64)
            entry[:, 2] = piece.column("k1").to_numpy()[record]
            entry[:, 3] = piece.column("k2").to_numpy()[record]
            entry[:, 4] = first[record] + suffix
            order, repeated, lead = equal_entries(entry)
            entry = entry[order]
            # one of equal suffixes goes on for all; it is marked as settled, for it may be the only one elsewhere
            sent = entry[lead]
            sent[:, 4] = sent[:, 4] * 2 + repeated[lead]
            done = entry[repeated]
            part = (sent[:, 0].astype(np.uint64) >> np.uint64(32)).astype(np.int64) % PARTS
            by_part = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by_part], np.arange(PARTS + 1))
            blobs = [sent[by_part[cuts[p] : cuts[p + 1]]].tobytes() for p in range(PARTS)]
            some = [p for p in range(PARTS) if blobs[p]]
            spans = span_rows(done[:, 2], done[:, 3], done[:, 4])
            # finished spans travel along, under parts below zero
            listed = pa.StructArray.from_arrays(spans.columns, fields=list(spans.schema))
            cut = [*[0] * (len(some) + 1), len(listed)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*some, -1 - int(done[0, 0]) % PARTS if len(done) else -1], pa.int32()),
                    pa.array([*[blobs[p] for p in some], b""], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), listed),
                ],
                ["part", "entries", "spans"],
            )


def equal_entries(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by hash, which entries in it have an equal, and the first of each run of equals."""
    order = np.lexsort((entry[:, 1], entry[:, 0]))
    a, b = entry[order, 0], entry[order, 1]
    same = np.zeros(len(order), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    return order, repeated, ~same


def part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finished spans, and those of the packed suffixes that have an equal in another batch."""
    part, held = None, []
    for batch in batches:
        done = batch.column("spans").flatten()
        yield pa.RecordBatch.from_arrays(done.flatten(), ["k1", "k2", "start", "end"])
        for p, entries in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
            if p != part:
                if held:
                    yield settled(held)
                part, held = p, []
            if entries:
                held.append(entries)
    if held:
        yield settled(held)


def settled(packed: list[bytes]) -> pa.RecordBatch:
    entry = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 5) for b in packed])
    order, repeated, _ = equal_entries(entry)
    entry = entry[order]
    new = repeated & (entry[:, 4] & 1 == 0)
    return span_rows(entry[new, 2], entry[new, 3], entry[new, 4] >> 1)


def result_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each unique text: (k1, k2, n_bytes, n_removed, n_spans, kept_sha256)."""
    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        removed, spans, digests = [], [], []
        copies = batch.column("copies").to_pylist()
        for i, cuts in enumerate(batch.column("spans").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            runs = kept_parts(len(text), copies[i], cuts or [])
            left = hashlib.sha256()
            at = n = 0
            for low, high in runs:
                left.update(text[at:low])
                n += high - low
                at = high
            left.update(text[at:])
            removed.append(n)
            spans.append(len(runs))
            digests.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("k1"),
                batch.column("k2"),
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(digests, pa.string()),
            ],
            names,
        )


def kept_parts(size: int, copies: int, cuts: list[dict]) -> list[tuple[int, int]]:
    """The maximal removed runs of a text, ascending."""
    if copies > 1 and size >= LENGTH:
        return [(0, size)]
    runs: list[tuple[int, int]] = []
    for low, high in sorted((c["start"], c["end"]) for c in cuts):
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], high))
        else:
            runs.append((low, high))
    return runs


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    The unique texts are shuffled once; finding anchors, cutting records and cutting texts all read that shuffle.
    """
    text = text_or_empty(text_col)
    texts = df.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), text.alias("text")
    )
    unique = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # all readers take the same columns, else the shuffle of the texts could not be shared
    anchors = stored(unique.mapInArrow(anchor_batches, ANCHORS), "anchors")
    zones = anchors.where("end > 0").select("k1", "k2", F.col("first").alias("start"), "end")
    salted = anchors.where("end = 0").drop("end").withColumn("salt", F.pmod(F.xxhash64("k1", "first"), F.lit(SALTS)).cast("int"))
    held = F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1), s)) != 0
    )
    repeated = (
        salted.groupBy("h")
        .agg(F.count("*").alias("total"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"))
        .where("total > 1")
        .select("h", F.explode(held).alias("salt"), (F.col("total") > HOT).alias("hot"))
    )
    listed = (
        salted.join(repeated, ["h", "salt"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("h", "hot", "first", "n", "place")).alias("records"))
    )
    met = unique.join(listed, ["k1", "k2"]).select("k1", "k2", "text", "copies", "records")
    records = met.mapInArrow(record_batches, RECORDS)
    cold = records.where(~F.col("hot")).repartition("h").sortWithinPartitions("h").mapInArrow(shard_batches, SPANS)
    packed = f"part int, entries binary, spans array<struct<{SPANS.replace(' ', ':').replace(',:', ',')}>>"
    hot = (
        records.where("hot")
        .mapInArrow(hot_batches, packed)
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(part_batches, SPANS)
    )
    cuts = cold.unionByName(hot).unionByName(zones).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    results = unique.join(cuts, ["k1", "k2"], "left").mapInArrow(result_batches, RESULTS)
    results = stored(results, "kept-texts")
    return texts.select("doc_id", "k1", "k2").join(results, ["k1", "k2"]).select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
