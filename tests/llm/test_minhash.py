from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from lexiloom.llm import minhash
from lexiloom.llm.components import components
from lexiloom.llm.minhash import BANDS, COORDINATES, band_keys, drop_near_copies, mark_near_copies, shingle_sets, sketches


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(s & t) >= 75 * len(s | t) and s for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: ([len(s) for s in sets[i]], find(i)) for i in ids}


def near_copies(seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    rows, at = [], 0
    for _ in range(12):
        text = rng.choices(words, k=rng.choice([3, 7, 40, 120, 400]))
        for _ in range(rng.randint(1, 14)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((at, rng.choice([" ", "  ", "\n"]).join(copy)))
            at += 1
    rng.shuffle(rows)
    return rows


def check(docs, rows):
    want = brute(rows)
    got = mark_near_copies(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        sizes, component = want[r.doc_id]
        assert r.n_shingles in sizes and r.component_id == component and r.kept == (r.doc_id == component)


def test_groups_equal_brute_force(docs):
    check(docs, near_copies())


def test_blocks_of_few_documents_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 100)
    check(docs, near_copies(9))


def test_edges(docs):
    text = "one two three four five six seven"
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, text), (8, text.upper()), (9, text),
        (9, text), (10, "other words stand here in this one"), (None, text), (None, None), (12, "é É b c d"), (13, "é É b c D"),
        (14, "x " * 4000), (15, "x " * 5000),
    ]
    check(docs, rows)


def test_an_id_with_two_texts_links_their_groups(docs):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = {(r.doc_id, r.component_id) for r in mark_near_copies(docs([(1, a), (2, a), (2, b), (3, b)])).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_dropping_keeps_columns(docs):
    df = docs(near_copies())
    kept = drop_near_copies(df)
    want = {c for _, c in brute(near_copies()).values()}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want


def test_empty_table(docs):
    assert mark_near_copies(docs([])).collect() == []


def test_sketches_are_full_and_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 5] = rng.integers(0, 2**63, n // 5, dtype=np.uint64)
        out = sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([n, n]))
        assert (out < np.uint64(2**64 - 1)).all()
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((out[0] == out[1]).mean() - similarity) < 0.15
    assert band_keys(out).shape == (2, BANDS) and out.shape[1] == COORDINATES


def test_shingles_do_not_cross_rows():
    codes, sizes = shingle_sets(pa.array(["a b c", "d e f", "a b c d e f", None, ""]))
    assert sizes.tolist() == [1, 1, 2, 0, 0]
    assert len(set(codes.tolist())) == 4


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: 0 if n < 100 else 100 if n < 200 else 200 for e in edges for n in e}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
