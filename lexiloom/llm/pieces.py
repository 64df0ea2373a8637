"""SentencePiece encoding and decoding by batched Viterbi over equal-length words.

A text becomes words: runs of the space sign with the signs after them. No piece holds a space sign after
another sign, so words are segmented on their own, each distinct one of a batch once. Words of one length
advance together: at each end position, the hashes of all substrings up to there, taken from prefix sums,
probe the sorted hashes of the pieces; every hit is scored, and vectorised maxima keep the best score and its
backpointer.

For unigram models, a path's score is the sum of its pieces' scores. For merge models (the public model is
one), the best sum is not what their own encoder gives, so a step also has a transition: it is open only if
the merges would leave the piece before and this piece apart. Exactly one piece is open at each position that
a merge sequence can stop at, so the best open path is the merge encoding; the test of a pair of pieces runs
the last merges of both pieces backwards, for all steps of a batch at once.

Signs that are no piece are encoded as byte pieces. Decoding joins pieces, turns space signs into spaces,
gathers byte pieces into characters (a faulty byte becomes the replacement character) and drops the space that
encoding put in front.

Defined results: null and empty texts have no ids, and no ids decode to the empty text; null ids are ids like
any other; equal rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import slices
from lexiloom.llm.splitting import BASE, mix, span_hashes
from lexiloom.shipping import ship

ship(__name__)

SPACE = "▁"
#: Kinds of pieces and of models in model files.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
BATCH_BYTES = 4 << 20
#: Words of one length that advance together.
ROWS = 1 << 14
LOW = -1e18
#: Leading bits of a hash that lead to its place among the sorted keys.
SLOT_BITS = 20
SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
#: Words whose ids a task remembers between batches; a cache only.
MEMO_WORDS = 150_000
#: Slots of the cache of tested pairs of pieces.
PAIR_BITS = 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        elif key & 7 == 5:
            at += 4
            yield key >> 3, data[at - 4 : at]
        else:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]


class PieceModel:
    """Pieces, scores and kinds of a model file, and whether it merges."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.kind, self.prefix, self.squeeze, normalizer = UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                normalizer = rules.get(2, b"")
        self.scores, self.kinds = np.array(scores), np.array(kinds)
        if self.kind not in (UNIGRAM, MERGES) or normalizer or self.squeeze or (self.kinds == USER).any():
            raise ValueError("only models of merges or unigrams without normalisation or user pieces are supported")
        held = [self.pieces[i] for i in np.flatnonzero(self.kinds == NORMAL)]
        if any(SPACE in piece.lstrip(SPACE) for piece in held):
            raise ValueError("a piece holds a space sign after another sign")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(f"utf-32-{sys.byteorder[0]}e"), np.uint32)


class PieceEncoder:
    """Encodes and decodes with one model; built once per task."""

    def __init__(self, data: bytes):
        model = PieceModel(data)
        self.model = model
        self.merges = model.kind == MERGES
        self.normal = np.flatnonzero(model.kinds == NORMAL)
        held = [model.pieces[i] for i in self.normal]
        self.longest = max(map(len, held))
        codes = code_points("".join(held))
        sizes = np.array([len(p) for p in held])
        ends = np.cumsum(sizes)
        hashes = self._raw(codes, ends - sizes, ends)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], self.normal[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("piece hashes clash")
        slots, first, n = np.unique(self.keys >> SLOT_SHIFT, return_index=True, return_counts=True)
        self.first_key = np.full(1 << SLOT_BITS, -1, np.int32)
        self.first_key[slots.astype(np.int64)] = first
        self.most_in_slot = int(n.max())
        self.memo: dict[int, bytes] = {}
        self.pair_at = np.full(1 << PAIR_BITS, -1)
        self.pair_apart = np.zeros(1 << PAIR_BITS, bool)
        self.score = model.scores.copy()
        self.unknown_score = float(model.scores[self.normal].min()) - 10
        size = len(model.pieces)
        self.hash_of = np.zeros(size, np.uint64)
        self.hash_of[self.normal] = hashes
        self.length_of = np.zeros(size, np.int64)
        self.length_of[self.normal] = sizes
        self.powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * self.longest, BASE, np.uint64)))
        self.left = np.full(size, -1)
        self.right = np.full(size, -1)
        self.reached = np.zeros(size, bool)
        if self.merges:
            self._derive(held)
        bytes_at = np.flatnonzero(model.kinds == BYTE)
        self.byte_id = {int(model.pieces[i][3:5], 16): int(i) for i in bytes_at}
        byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        unknown = np.flatnonzero(model.kinds == UNKNOWN)
        self.unknown_id = int(unknown[0]) if len(unknown) else 0
        shown = [
            byte_of.get(i, b"") if k in (CONTROL, BYTE) else p.replace(SPACE, " ").encode()
            for i, (p, k) in enumerate(zip(model.pieces, model.kinds.tolist()))
        ]
        self.spelled = np.frombuffer(b"".join(shown), np.uint8)
        self.size_of = np.array([len(b) for b in shown], np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of

    @staticmethod
    def _raw(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hashes that can be extended: the sum of mixed signs times powers of the base."""
        with np.errstate(over="ignore"):
            signs = mix(codes.astype(np.uint64) + np.uint64(1))
            out = np.zeros(len(starts), np.uint64)
            power = np.uint64(1)
            for i in range(int((ends - starts).max(initial=0))):
                some = np.flatnonzero(ends - starts > i)
                out[some] += signs[starts[some] + i] * power
                power *= BASE
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1: the sorted keys are probed from the first one of equal leading bits."""
        slot = self.first_key[(hashes >> SLOT_SHIFT).astype(np.int64)]
        out = np.full(len(hashes), -1)
        held = np.flatnonzero(slot >= 0)
        if len(held):
            at, sought = slot[held], hashes[held]
            for _ in range(self.most_in_slot):
                same = self.keys[at] == sought
                out[held[same]] = self.ids[at[same]]
                at = np.minimum(at + 1, len(self.keys) - 1)
        return out

    def _derive(self, held: list[str]) -> None:
        """The last merge of every piece that merging its own signs arrives at; single signs have none."""
        rank = {p: float(s) for p, s in zip(held, self.score[self.normal])}
        number = dict(zip(held, self.normal.tolist()))
        for piece, at in number.items():
            parts = list(piece)
            last = None
            while len(parts) > 1:
                best, where = None, -1
                for i in range(len(parts) - 1):
                    score = rank.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, where = score, i
                if best is None:
                    break
                last = (parts[where], parts[where + 1])
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            if len(parts) == 1:
                self.reached[at] = True
                if last:
                    self.left[at] = number.get(last[0], -2)
                    self.right[at] = number.get(last[1], -2)

    def apart(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces apart; -1 is a sign without a piece. Answers are kept."""
        pair = (before + 1) * (len(self.score) + 1) + after + 1
        with np.errstate(over="ignore"):
            slot = (mix(pair.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pair_at[slot] != pair)
        out = self.pair_apart[slot]
        if len(new):
            pairs, first, number = np.unique(pair[new], return_index=True, return_inverse=True)
            fresh = self.tested(before[new[first]], after[new[first]])
            out[new] = fresh[number]
            self.pair_at[slot[new]], self.pair_apart[slot[new]] = pair[new], out[new]
        return out

    def tested(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces apart.

        Going back through the last merges of both, a merge across the border that comes before the next
        merge on its own side would have joined them. Equal ranks merge from the left.
        """
        out = np.ones(len(before), bool)
        live = np.flatnonzero((before >= 0) & (after >= 0))
        a, b = before[live].copy(), after[live].copy()
        # the merges that formed what stands left and right of the border come after these limits
        limit = np.full(len(live), -np.inf)
        strict = np.zeros(len(live), bool)
        while len(live):
            with np.errstate(over="ignore"):
                joined = self.find(self.hash_of[a] + self.hash_of[b] * self.powers[self.length_of[a]])
            score = np.where(joined >= 0, self.score[joined], -np.inf)
            merges = np.where(strict, score > limit, score >= limit) & (joined >= 0)
            out[live[merges]] = False
            last_a = np.where(self.left[a] == -1, np.inf, self.score[a])
            last_b = np.where(self.left[b] == -1, np.inf, self.score[b])
            done = merges | (np.isinf(last_a) & np.isinf(last_b))
            # undo the later of the two last merges; of equal ranks, the right one came later
            undo_b = last_b <= last_a
            limit = np.where(undo_b, last_b, last_a)
            # a merge across the border at the rank of the undone merge on its right comes first, on its left after
            strict = ~undo_b
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
            kept = ~done & (a >= 0) & (b >= 0)
            live, a, b, limit, strict = live[kept], a[kept], b[kept], limit[kept], strict[kept]
        return out

    def segment(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length (a matrix of signs): the piece and the start of the one ending at each place."""
        rows, width = words.shape
        with np.errstate(over="ignore"):
            signs = mix(words.astype(np.uint64) + np.uint64(1))
            base = np.uint64(pow(int(BASE), -1, 1 << 64))
            powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(width, BASE, np.uint64)))
            backs = np.multiply.accumulate(np.append(np.uint64(1), np.full(width, base, np.uint64)))
            sums = np.zeros((rows, width + 1), np.uint64)
            np.cumsum(signs * powers[:width], axis=1, out=sums[:, 1:])
        best = np.full((width + 1, rows), LOW)
        best[0] = 0
        piece = np.full((width + 1, rows), -1)
        back = np.full((width + 1, rows), -1)
        sums = np.ascontiguousarray(sums.T)
        for end in range(1, width + 1):
            for start in range(max(0, end - self.longest), end):
                # a merge sequence has one open piece at each place, so its rows are done when they have it
                live = best[start] > LOW
                if self.merges:
                    live &= best[end] == LOW
                live = np.flatnonzero(live)
                with np.errstate(over="ignore"):
                    found = self.find((sums[end, live] - sums[start, live]) * backs[start])
                if end - start > 1:
                    hit = np.flatnonzero(found >= 0)
                    live, found = live[hit], found[hit]
                if self.merges and len(live):
                    open_ = np.where(found >= 0, self.reached[found], True)
                    if start:
                        open_ &= self.apart(piece[start, live], found)
                    live, found = live[open_], found[open_]
                if not len(live):
                    continue
                step = np.where(found >= 0, self.score[found], self.unknown_score)
                total = best[start, live] + (0 if self.merges else step)
                better = total > best[end, live]
                live, found = live[better], found[better]
                best[end, live], piece[end, live], back[end, live] = total[better], found, start
        return piece, back

    def word_ids(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of each word, as 32-bit integers end to end."""
        out = [b""] * len(starts)
        if not out:
            return out
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(sizes[order]) != 0)).tolist() + [len(order)]
        for low, high in zip(cuts, cuts[1:]):
            width = int(sizes[order[low]])
            room = max(1, min(ROWS, (ROWS << 4) // max(1, width)))
            for first in range(low, high, room):
                at = order[first : min(high, first + room)]
                words = codes[starts[at][:, None] + np.arange(width)]
                for word, ids in zip(at.tolist(), self.followed(words, *self.segment(words))):
                    out[word] = ids
        return out

    def followed(self, words: np.ndarray, piece: np.ndarray, back: np.ndarray) -> list[bytes]:
        """Ids along the backpointers of every word, all words one step at a time."""
        rows, width = words.shape
        at = np.full(rows, width)
        n = np.zeros(rows, np.int64)
        taken = np.zeros((rows, width), np.int64)
        live = np.arange(rows)
        plain = np.ones(rows, bool)
        while len(live):
            end = at[live]
            found = piece[end, live]
            # a sign without a piece is kept as its place, below zero
            taken[live, n[live]] = np.where(found >= 0, found, -end)
            plain[live] &= found >= 0
            n[live] += 1
            at[live] = back[end, live]
            live = live[at[live] > 0]
        upto = np.cumsum(n)
        row = np.repeat(np.arange(rows), n)
        flat = taken[row, np.repeat(upto, n) - 1 - np.arange(int(upto[-1]))].astype(np.int32)
        data, cuts = flat.tobytes(), (upto * 4).tolist()
        out = [data[low:high] for low, high in zip([0, *cuts], cuts)]
        for i in np.flatnonzero(~plain).tolist():
            ids = np.frombuffer(out[i], np.int32).tolist()
            spelled = [j for k in ids for j in ([k] if k >= 0 else self.sign_ids(chr(int(words[i, -k - 1]))))]
            out[i] = np.array(spelled, np.int32).tobytes()
        return out

    def remembered(self, hashes: list[int], codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of each distinct word, from earlier batches where they are known."""
        found = [self.memo.get(h) for h in hashes]
        new = [i for i, ids in enumerate(found) if ids is None]
        room = MEMO_WORDS - len(self.memo)
        for i, ids in zip(new, self.word_ids(codes, starts[new], ends[new])):
            found[i] = ids
            if room > 0:
                self.memo[hashes[i]] = ids
                room -= 1
        return found

    def sign_ids(self, sign: str) -> list[int]:
        data = sign.encode("utf-8")
        return [self.byte_id[b] for b in data] if self.byte_id else [self.unknown_id]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each."""
        prepared = [(SPACE if self.model.prefix and t else "") + t.replace(" ", SPACE) for t in texts]
        lengths = np.fromiter(map(len, prepared), np.int64, len(prepared))
        codes = code_points("".join(prepared))
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        space = codes == ord(SPACE)
        begins = np.zeros(len(codes), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))
        owner = np.repeat(np.arange(len(texts)), lengths)[starts]
        distinct, first, number = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        found = self.remembered(distinct.tolist(), codes, starts[first], ends[first])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        begin = np.cumsum(sizes) - sizes
        n = sizes[number]
        at = np.arange(int(n.sum())) + np.repeat(begin[number] - (np.cumsum(n) - n), n)
        return flat[at], np.bincount(owner, n, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """Texts of rows of ids laid end to end, ``n`` ids each: the bytes of all pieces are gathered at once.

        Byte runs that are no UTF-8 become U+FFFD.
        """
        sizes = self.size_of[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        shift = self.start_of[ids] - (ends - sizes)
        flat = self.spelled[np.arange(total) + np.repeat(shift, sizes)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(n))]
        starts, stops = bounds[:-1].copy(), bounds[1:]
        if self.model.prefix:
            led = np.flatnonzero(stops > starts)
            led = led[flat[starts[led]] == ord(" ")]
            # the space that encoding put before the text goes
            starts[led] += 1
            kept = np.ones(total, bool)
            kept[starts[led] - 1] = False
            flat = flat[kept]
            bounds = np.append(0, np.cumsum(stops - starts))
        data = pa.py_buffer(flat.tobytes())
        raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), data])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in raw.to_pylist()], pa.string())


def encoded(encoder: PieceEncoder, batch: pa.RecordBatch) -> pa.Array:
    ids, n = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
    offsets = np.zeros(len(n) + 1, np.int32)
    offsets[1:] = np.cumsum(n)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def decoded(encoder: PieceEncoder, column: pa.Array) -> pa.Array:
    """The texts of lists of ids; a null list gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return encoder.decode(column.flatten().to_numpy(zero_copy_only=False), n.astype(np.int64))


def encode_batches(data, back: bool):
    """Adds ``ids``, and with ``back`` also ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, "text", BATCH_BYTES):
            encoder = encoder or PieceEncoder(data.value)
            ids = encoded(encoder, batch)
            batch = batch.append_column("ids", ids)
            yield batch.append_column("decoded", decoded(encoder, ids)) if back else batch

    return run


def decode_batches(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, "text", BATCH_BYTES):
            encoder = encoder or PieceEncoder(data.value)
            yield batch.append_column("decoded", decoded(encoder, batch.column("ids")))

    return run


def _model(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) for each row; the driver reads the model file."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(encode_batches(_model(df, model_path), False), "doc_id bigint, text string, ids array<int>")


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids, decoded) for each row: ``encode`` and ``decode`` in one pass."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id bigint, text string, ids array<int>, decoded string"
    return texts.mapInArrow(encode_batches(_model(df, model_path), True), kinds)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to (doc_id, text, ids)."""
    kinds = "doc_id bigint, text string, ids array<int>, decoded string"
    return encoded.mapInArrow(decode_batches(_model(encoded, model_path)), kinds)

