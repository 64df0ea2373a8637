from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import suffix_dedup
from lexiloom.llm.common import text_bytes
from lexiloom.llm.suffix_dedup import Hasher, anchor_runs, induce, remove_repeats, sliding_least


def covered(texts):
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i : i + 200] = True
        out.append(mark)
    return out


def passages(seed, letters):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choices(letters, k=n))
    shared = [some(rng.randint(150, 600)) for _ in range(5)]
    texts = []
    for _ in range(40):
        parts = [rng.choice([some(rng.randint(0, 300)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 90) :]]) for _ in range(rng.randint(0, 4))]
        texts.append("".join(parts))
    line = some(90)
    return [*texts, "", line * 20, some(30) + line * 7, "ab" * 110 + some(50), "b" * 200, "b" * 700 + "ab" * 300, "a" * 900, "ab" * 350, "x" * 199, "x" * 200, some(4000), "ü" * 150, "ü" * 99]


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefgh "), (3, "aé ")])
def test_induction_finds_all_repeated_suffixes(seed, letters):
    texts = list(dict.fromkeys(passages(seed, letters)))
    data, offsets = text_bytes(pa.array(texts))
    h, row, first, n, place, end = anchor_runs(data, offsets, Hasher())
    marks = [np.zeros(len(t.encode()), bool) for t in texts]
    for r in np.flatnonzero(end):
        marks[row[r]][first[r] : end[r]] = True
    h, row, first, n, place = (c[end == 0] for c in (h, row, first, n, place))
    record, suffix = induce(h, data, offsets[row] + first, n, place)
    for r, s in zip(record, suffix):
        marks[row[r]][first[r] + s : first[r] + s + 200] = True
    for got, want in zip(marks, covered([t.encode() for t in texts])):
        assert (got == want).all()


def test_records_cover_each_suffix_once():
    texts = passages(5, "abcdef")
    data, offsets = text_bytes(pa.array(texts))
    _, row, first, n, place, end = anchor_runs(data, offsets, Hasher())
    # a suffix in no record lies within a zone
    for i, t in enumerate(texts):
        mine = (row == i) & (end == 0)
        held = np.concatenate([np.arange(f, f + k) for f, k in zip(first[mine], n[mine])] or [np.empty(0, int)])
        assert len(held) == len(set(held))
        missing = set(range(len(t.encode()) - 199)) - set(held)
        zones = list(zip(first[(row == i) & (end > 0)], end[(row == i) & (end > 0)]))
        assert all(any(low <= m and m + 200 <= high for low, high in zones) for m in missing)
    assert (place >= n - 1).all() and (place <= 200 - 64).all()


@pytest.mark.parametrize("period", [1, 2, 7, 64, 130])
def test_periodic_text_takes_few_records(period, monkeypatch):
    unit = "".join(random.Random(period).choices("abcdefgh", k=period))
    text = (unit * (1_000_000 // period + 1))[:1_000_000]
    data, offsets = text_bytes(pa.array([text]))
    *_, n, _, end = anchor_runs(data, offsets, Hasher())
    assert (n[end == 0] + 199).sum() < 2_000_000 // 100
    assert (end > 0).sum() < 20


def test_one_period_and_a_lone_suffix(docs):
    # the other texts hold single suffixes of the long run, or one byte less
    rows = [(1, "a" * 100_000), (2, "x" + "a" * 200 + "y"), (3, "w" + "a" * 199 + "z"), (4, "ab" * 50_000), (5, "ba" * 100 + "c")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(docs(rows)).collect()}
    assert got == {1: (100_000, 1), 2: (200, 1), 3: (0, 0), 4: (100_000, 1), 5: (200, 1)}


def test_sliding_least():
    values = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    for width in (1, 7, 137, 500):
        assert (sliding_least(values, width) == [values[i : i + width].min() for i in range(501 - width)]).all()


@pytest.mark.parametrize("hot", [4096, 2])
def test_rows_equal_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    texts = [*passages(7, "abcd "), None]
    rows = [*enumerate(texts), (None, texts[0] * 3), (3, texts[3]), (3, texts[4])]
    got = remove_repeats(docs(rows)).collect()
    want = []
    for (i, t), mark in zip(rows, covered([(t or "").encode() for _, t in rows])):
        data = (t or "").encode()
        kept = np.frombuffer(data, np.uint8)[~mark].tobytes()
        starts = int((mark & ~np.concatenate([[False], mark[:-1]])).sum()) if len(mark) else 0
        want.append((i, len(data), int(mark.sum()), starts, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(docs):
    assert remove_repeats(docs([])).collect() == []
