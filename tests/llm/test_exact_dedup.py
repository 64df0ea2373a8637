from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lexiloom.llm.exact_dedup import clashes, drop_copies, mark_copies, recipes

random.seed(3)
LONG = " ".join("".join(random.choices("abcdefinorst", k=random.randint(2, 9))) for _ in range(6000))
ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (4, "a b "), (1, None), (2, ""), (8, "  "), (6, LONG), (7, LONG.replace(" ", "\n")),
    (10, LONG + "x"), (11, "x" * 9000), (12, "x" * 9001), (12, "x" * 9001), (None, "lone"), (None, "a b"), (13, "ü  ß"),
]


def wanted():
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups_of_equal_texts(docs):
    got = [tuple(r) for r in mark_copies(docs(ROWS)).collect()]
    assert sorted(got, key=str) == wanted()


def test_weak_identifiers_are_widened_until_no_two_chunks_share_one(docs):
    weak = lambda chunk, number: F.pmod(F.xxhash64(F.lit(number), chunk), F.lit(2))
    got = [tuple(r) for r in mark_copies(docs(ROWS[:7] + ROWS[13:]), word=weak).collect()]
    expected = [tuple(r) for r in mark_copies(docs(ROWS[:7] + ROWS[13:])).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    chunks = docs([(1, "p"), (2, "q"), (3, "q")]).select(F.lit(1).alias("identifier"), F.col("text").alias("chunk"))
    assert clashes(chunks).count() == 1


def test_chunks_are_bounded_and_follow_the_content(docs):
    listed = {r.doc_id: r.recipe for r in recipes(docs([(6, LONG), (7, "new start " + LONG)]), "doc_id", "text").collect()}
    pairs = [{tuple(x[i : i + 2]) for i in range(0, len(x), 2)} for x in listed.values()]
    assert len(pairs[0]) > 20
    assert len(pairs[0] & pairs[1]) > len(pairs[0]) * 0.7


def test_dropping_keeps_columns_and_one_of_each_group(docs):
    df = docs(ROWS)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, 1, 8, 6, 10, 11, 12, None, 13], key=str)


def test_one_of_equal_rows_stays(docs):
    rows = [(1, "a  b")] * 3 + [(2, "a b")] + [(None, "c")] * 2 + [(3, None)] * 2 + [(1, "d")] * 2 + [(4, "e")]
    kept = [(r.doc_id, r.text) for r in drop_copies(docs(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a  b"), (None, "c"), (3, None), (1, "d"), (4, "e")], key=str)


def test_empty_table(docs):
    assert mark_copies(docs([])).collect() == [] and drop_copies(docs([])).collect() == []


def test_no_python_in_the_plan(docs):
    plan = mark_copies(docs(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
