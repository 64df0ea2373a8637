from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.scoring import garbled_share, repeated_share
from lexiloom.operators import evaluate, order


@pytest.fixture
def scored(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "case_no int, run bigint, reply string")
        cases = spark.createDataFrame(
            [(0, "a", "p a", ["ok", "sea"]), (1, "b", "p b", ["x", "y", "z"]), (2, "none", "p c", [])],
            "case_no int, case_id string, prompt string, keywords array<string>",
        )
        return evaluate.score_replies(df, cases)

    return run


def test_scores(scored):
    words30, words31 = " ".join(["w"] * 30), " ".join(["w"] * 31)
    rows = [
        (0, 0, ""), (0, 1, "Look"), (0, 2, "ok by the sea"), (0, 3, words30), (0, 4, words31),
        (1, 5, "x and z"), (2, 6, "anything"), (2, 7, words31),
    ]
    got = {r["run"]: (r["hits"], r["style_ok"], round(r["score"], 6)) for r in scored(rows).collect()}
    assert got == {
        0: ([], True, 0.1),
        1: (["ok"], True, 0.6),
        2: (["ok", "sea"], True, 1.0),
        3: ([], True, 0.1),
        4: ([], False, 0.0),
        5: (["x", "z"], True, round(2 / 3 + 0.1, 6)),
        6: ([], True, 0.1),
        7: ([], False, 0.0),
    }


def test_averages(scored):
    rows = [(0, 0, ""), (0, 1, "ok"), (1, 0, "x y z")]
    got = {r["case_id"]: (r["n"], round(r["avg_score"], 6)) for r in evaluate.average_score(scored(rows)).collect()}
    assert got == {"a": (2, 0.35), "b": (1, 1.0), "all": (3, round(1.7 / 3, 6))}


def test_reports(scored):
    rows = [(0, 0, "old"), (0, 1, "ok"), (1, 5, "x"), (2, 3, "fine")]
    latest = evaluate.latest_per_case(scored(rows), ["run"])
    report = json.loads(evaluate.report_document(latest).first()["report"])
    assert [c["id"] for c in report["cases"]] == ["a", "b", "none"]
    assert [c["reply"] for c in report["cases"]] == ["ok", "x", "fine"]
    assert report["avg_score"] == pytest.approx((0.6 + 1 / 3 + 0.1 + 0.1) / 3, abs=1e-6)
    lines = {r["run"]: r["t"] for r in latest.select("run", evaluate.report_lines(latest).alias("t")).collect()}
    assert lines[1] == "[a] score=0.60 style=ok\nprompt: p a\nreply:  ok\nhits:   ok"
    assert lines[3].endswith("hits:   -")


def test_history(scored, monkeypatch):
    monkeypatch.setattr(order, "RANGES", 3)
    replies = {0: "", 1: "ok", 4: "sea", 9: "ok sea", 30: ""}
    rows = [(0, run, text) for run, text in replies.items()] + [(1, 2, "x"), (0, 1, "sea")]
    history = evaluate.score_history(scored(rows), "run")
    got = {(r["case_id"], r["run"]): r["prev_score"] for r in history.collect()}
    want = {("a", 0): None, ("a", 1): 0.1, ("a", 4): 0.6, ("a", 9): 0.6, ("a", 30): 1.0, ("b", 2): None}
    assert got == pytest.approx(want)


def test_penalties(column):
    assert column(["", "ab", "a�", "\x00\x01"], garbled_share(F.col("t"))) == [0.0, 0.0, 0.5, 1.0]
    values = ["", "one", "a b", "a b a b", "x x x x"]
    assert column(values, repeated_share(F.col("t"))) == pytest.approx([0, 0, 0, 1 / 3, 2 / 3])


def test_comparison(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, reply string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "id int, expected string")
    got = {r["id"]: r["status"] for r in evaluate.compare_replies(a, b, ["id"]).collect()}
    assert got == {1: "extra", 2: "same", 3: "different", 4: "missing"}


def test_case_table(spark):
    rows = evaluate.case_table(spark).collect()
    assert len(rows) == 16 and len({r["case_id"] for r in rows}) == 16
    assert all(3 <= len(r["keywords"]) <= 5 for r in rows)


def test_many_keywords_equal_contains(spark):
    from lexiloom.operators.keywords import find_keywords

    rng = random.Random(7)
    words = ["".join(rng.choices("abé\U0001f600", k=rng.randint(1, 5))) for _ in range(400)]
    texts = ["".join(rng.choices("abé\U0001f600 ", k=rng.randint(0, 60))) for _ in range(60)] + ["", None, "ab" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    keywords = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "keyword string")
    found = {r["i"]: r["hits"] for r in find_keywords(docs, keywords).collect()}
    for i, text in enumerate(texts):
        assert found[i] == (None if text is None else sorted(w for w in set(words) if w in text))
    none = find_keywords(docs, keywords.where("keyword = 'absent'")).collect()
    assert all(r["hits"] == (None if r["text"] is None else []) for r in none)
    assert find_keywords(docs.limit(0), keywords).count() == 0


def test_a_stored_log_is_made_once(spark, monkeypatch):
    """The log is written in two parts, but the models behind it are learned once."""
    from lexiloom.plans import store_queries

    made = spark.sparkContext.accumulator(0)

    def row(step):
        made.add(1)
        return step / 2

    def eval_log(*args):
        steps = spark.range(1, 5).select(F.col("id").cast("int").alias("model_order"))
        loss = F.udf(row, "double")("model_order")
        return steps.withColumn("train_loss", loss).withColumn("val_loss", F.lit(1.0))

    monkeypatch.setattr(store_queries, "eval_log", eval_log)
    monkeypatch.setattr(store_queries, "_documents", lambda *args: None)
    got = sorted(tuple(r) for r in store_queries.log_store(spark, "").collect())
    assert got == [(i, i / 2, 1.0, store_queries.RATE) for i in range(1, 5)]
    assert made.value == 4


def test_losses_of_both_splits_read_the_counts_of_one_pass(spark):
    from lexiloom.plans.train import eval_log

    docs = spark.createDataFrame([(i, "abc " * i) for i in range(20)], "id int, text string")
    log = eval_log(docs, "id", "text", [1, 2])
    # only the validation texts are still to be counted
    assert log._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert log.count() == 2
