from __future__ import annotations

import zlib

import numpy as np
import pytest

from lexiloom.llm.sharding import permute, shard


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one_and_can_be_undone(n):
    numbers = np.arange(n)
    places = permute(numbers, n, 7)
    assert sorted(places.tolist()) == list(range(n))
    assert (permute(places, n, 7, back=True) == numbers).all()


def test_permutation_depends_on_the_seed():
    assert (permute(np.arange(1000), 1000, 1) != permute(np.arange(1000), 1000, 2)).any()


def test_shards_are_even_gapless_and_reproducible(docs):
    rows = [(i, f"text {i}") for i in range(100)] + [(None, None), (7, ""), (7, "text 7"), (7, "text 7")] + [(5, "é" * 40)]
    df = docs(rows)
    got = shard(df, shards=16, seed=3).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1) for i, t in rows
    )
    assert {(r.size, r.text_crc32) for r in got} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows}
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    again = shard(df.repartition(5), shards=16, seed=3).collect()
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_many_copies_of_one_row(docs):
    got = shard(docs([(1, "same")] * 2500), shards=16).collect()
    assert len({(r.shard, r.slot) for r in got}) == 2500


def test_empty_table_and_faulty_arguments(docs):
    assert shard(docs([])).collect() == []
    with pytest.raises(ValueError):
        shard(docs([]), shards=0)
