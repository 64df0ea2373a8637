from __future__ import annotations

import re
from itertools import permutations

from lexiloom.llm.filter_audit import COUNTS, audit

KIND = "doc_id bigint, text string, lang string, mask int, n string, part string, digest int, good int"
FEW, MANY = "one two", " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, FEW, "en"), (2, FEW, "en"), (3, FEW, "de"), (3, FEW, "de"), (None, FEW, "en"), (4, MANY, "en"), (5, MANY + " $", "en"),
    (6, "w " * 150, "en"), (7, "w " * 150, None), (8, None, None), (9, "", ""), (10, None, "en"), (11, "ABC | def", "de"),
    (12, MANY.upper() + " Q" * 200, "de"), (2, MANY, "de"), (1, FEW, "en"), (None, None, "fr"), (13, "Ä ü é", "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (5, 1, 1), (7, 0, 1), (None, 1, 1), (12, 1, 0), (99, 1, 1)]


def fails(doc_id, text, rows):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
    }


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    out = []
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, fails(i, t, rows)) for i, t, lang in rows if (lang or "") == part]
        of_part, removals = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = order[: step - 1]
                gone = [any(m[x] for x in before) for _, m in own]
                hit = [m[f] and not g for (_, m), g in zip(own, gone)]
                removals[f] += sum(hit)
                counts = (
                    sum(not g and not m[f] for (_, m), g in zip(own, gone)),
                    sum(hit),
                    sum(g and m[f] for (_, m), g in zip(own, gone)),
                    sum(m[f] and sum(m.values()) == 1 for _, m in own),
                    sum(h and i in good for (i, _), h in zip(own, hit)),
                    sum(h and i in toxic for (i, _), h in zip(own, hit)),
                )
                of_part.append((part, "".join(order), step, f, *counts))
        out += [(*row, removals[row[3]]) for row in of_part]
    return sorted(out)


def found(spark, rows, labels):
    df = spark.createDataFrame([(*r, 1, "n", "p", 2, 3) for r in rows], KIND)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = audit(df, marks)
    assert out.columns == ["part", "filter_order", "step", "filter", *COUNTS, "shapley"]
    return sorted(tuple(r) for r in out.collect())


def test_equals_brute_force(spark):
    want = brute(ROWS, LABELS)
    assert found(spark, ROWS, LABELS) == want and len(want) == 4 * 600


def test_one_large_group_of_copies(spark):
    rows = [(i, MANY, "en") for i in range(500)] + [(None, MANY, "en")] * 50 + [(0, MANY, "de")] * 3
    got = {r[1:3]: r for r in found(spark, rows, []) if r[0] == "en"}
    assert got["EABCD", 1][4:6] == (51, 499)


def test_very_long_text(spark):
    rows = [(1, "x" * 3_000_000, "en"), (2, "a b " * 600_000, "en")]
    assert found(spark, rows, []) == brute(rows, [])


def test_empty_tables(spark):
    assert found(spark, [], LABELS) == []
    assert found(spark, ROWS[:3], []) == brute(ROWS[:3], [])
