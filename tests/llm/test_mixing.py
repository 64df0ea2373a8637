from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import mixing
from lexiloom.llm.mixing import mix, plan_mix

KIND = "doc_id bigint, text string, source string, key string, size int, salt int, target string, row string"


def n_words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by clamping and resharing, source by source, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {}
    while True:
        free = [s for s in names if s not in target]
        left = sum(sizes.values()) - sum(target.values())
        share = {s: Fraction(left * weight[s], sum(weight[t] for t in free)) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return target | share
        target |= {s: Fraction(epochs * sizes[s]) for s in over}


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "t", "r") for r in rows], KIND)


def corpus(seed, sources, n):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(sources)) for i in range(n)]


CASES = [
    corpus(1, ["a"] * 9 + ["b", "c", "é", "🙂", "Z", None, ""], 400),
    corpus(2, ["a"] + ["z"] * 40, 200),
    corpus(3, [f"s{i}" for i in range(40)], 300),
    [(1, "a b c", "x"), (2, "d", "y"), (3, None, "z"), (None, " \t\x0b ", None), (None, None, None)],
    [(1, None, "x"), (2, "", None)],
]


@pytest.mark.parametrize("rows", CASES)
def test_targets_and_takings(spark, rows):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text)
    want = brute_targets(sizes)
    got = plan_mix(table(spark, rows)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    taken, text_of = Counter(), {r[0]: r[1] for r in rows}
    for r in got:
        assert r.size == n_words(text_of[r.doc_id]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= Fraction(1, 2)


def test_order_is_seeded_and_reruns_agree(spark):
    rows = CASES[0]
    first = sorted(map(str, plan_mix(table(spark, rows)).collect()))
    again = plan_mix(table(spark, rows[::-1]).repartition(7))
    assert sorted(map(str, again.collect())) == first
    assert sorted(map(str, plan_mix(table(spark, rows), seed=7).collect())) != first
    # whole documents of smaller hashes come first
    extra = [r for r in plan_mix(table(spark, rows)).collect() if r.source == "a" and r.size]
    text_of = {r[0]: r[1] for r in rows}
    extra.sort(key=lambda r: hashlib.md5(f"42 {r.doc_id} {text_of[r.doc_id]}".encode()).hexdigest()[:15])
    parts = [r.part_words == r.size for r in extra]
    assert parts == sorted(parts, reverse=True)
    assert sum(0 < r.part_words < r.size for r in extra) <= 1


def test_one_bucket_or_many(spark, monkeypatch):
    want = sorted(map(str, plan_mix(table(spark, CASES[0])).collect()))
    for buckets in (2, 1 << 20):
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        assert sorted(map(str, plan_mix(table(spark, CASES[0])).collect())) == want


def test_repeated_rows_share_the_end(spark):
    rows = [(1, "a b c d e f g", "x")] * 20 + [(2, "v " * 200, "y")]
    got = [r.taken for r in plan_mix(table(spark, rows)).collect() if r.doc_id == 1]
    want = brute_targets({"x": 140, "y": 200})["x"]
    assert len(got) == 20 and len(set(got)) == 1
    assert abs(sum(got) - want) <= 10


def test_the_mix_itself(spark):
    rows = CASES[0] + CASES[3]
    df = table(spark, rows)
    plan = plan_mix(df).groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0").collect()
    out = mix(df)
    assert out.columns == df.columns
    got, texts = Counter(), {t for _, t, _ in rows}
    for r in out.collect():
        got[r.source] += n_words(r.text)
        assert any((t or "").startswith(r.text) for t in texts) and r.key == "k" and r.row == "r"
    assert got == {r.source: r.n for r in plan}


def test_empty_table(spark):
    assert plan_mix(table(spark, [])).collect() == [] and mix(table(spark, [])).collect() == []
