from __future__ import annotations

import math
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.chat import close_turn
from lexiloom.functions.text import byte_ids
from lexiloom.functions.vectors import softmax
from lexiloom.operators import generate as generation
from lexiloom.operators import kernels, ngram
from lexiloom.operators.evaluate import sweep_summary
from lexiloom.operators.generate import byte_prompts, free_prompts, generate, token_prompts
from lexiloom.operators.ngram import Alphabet
from lexiloom.operators.selection import batch_loss, best_model, eval_steps, improvements, selection_metric
from lexiloom.plans import model_queries
from lexiloom.plans.train import best_order, eval_log

TEXTS = ["abab", "ba", "", "aé", "abcabc" * 20]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def brute_grams(tokens, order, pad=256, end=256):
    line = [pad] * (order - 1) + list(tokens) + ([] if end is None else [end])
    for i in range(order - 1, len(line)):
        context = 0
        for t in line[i - order + 1 : i]:
            context = context * 257 + t
        yield context, line[i]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
@pytest.mark.parametrize("piece", [3, kernels.PIECE])
def test_counts(spark, order, piece, monkeypatch):
    monkeypatch.setattr(kernels, "PIECE", piece)
    want = Counter(g for t in TEXTS for g in brute_grams(t.encode(), order))
    got = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [order]).collect()
    assert {(r["context"], r["next"]): r["n"] for r in got} == want


@pytest.mark.parametrize("order", [1, 3])
def test_example_weights_sum_to_one_per_row(spark, order):
    want = Counter()
    for t in TEXTS:
        grams = list(brute_grams(t.encode(), order))
        for g in grams:
            want[g] += Fraction(1, len(grams))
    got = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [order], weighting="example").collect()
    assert {(r["context"], r["next"]) for r in got} == set(want)
    assert all(r["n"] == pytest.approx(float(want[r["context"], r["next"]])) for r in got)


def test_token_arrays_without_end(spark):
    rows = [[1, 2, 1, 2], [2], [], [0, 1]]
    df = spark.createDataFrame([(r,) for r in rows], "tokens array<int>")
    got = ngram.count_ngrams(df, "tokens", [2], Alphabet(257, 0, None)).collect()
    want = Counter(g for r in rows for g in brute_grams(r, 2, 0, None))
    assert {(r["context"], r["next"]): r["n"] for r in got} == want


def test_arguments_are_checked(spark):
    docs = docs_of(spark, ["a"])
    with pytest.raises(ValueError):
        ngram.count_ngrams(docs, "text", [0])
    with pytest.raises(ValueError):
        ngram.count_ngrams(docs, "text", [9])
    with pytest.raises(ValueError):
        ngram.count_ngrams(docs, "text", [1], weighting="other")


def brute_loss(counts, tokens, order):
    totals = Counter()
    for (context, _), n in counts.items():
        totals[context] += n
    grams = list(brute_grams(tokens, order))
    losses = []
    for context, token in grams:
        p = counts[context, token] / totals[context] if totals[context] else 0.0
        losses.append(-math.log(max(p, 1e-12)))
    return sum(losses) / len(losses)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot", [2, ngram.HOT])
def test_losses(spark, order, hot, monkeypatch):
    """Unseen contexts, unseen targets and certain targets; with few and with many hot n-grams."""
    monkeypatch.setattr(ngram, "HOT", hot)
    if order == 3:
        monkeypatch.setattr(ngram, "BROADCAST_ROWS", 0)
    train, held = docs_of(spark, TEXTS), docs_of(spark, ["ab", "zz", "", "abcabc", "é"])
    counts = Counter(g for t in TEXTS for g in brute_grams(t.encode(), order))
    model = ngram.count_ngrams(train, "text", [order])
    want = {i: brute_loss(counts, t.encode(), order) for i, t in enumerate(["ab", "zz", "", "abcabc", "é"])}
    got = {r["doc_id"]: r["loss"] for r in ngram.example_loss(held, "doc_id", "text", model, order).collect()}
    assert got == pytest.approx(want)
    split = ngram.split_loss(held, "text", model, [order]).first()
    assert split["n_examples"] == 5
    assert split["loss"] == pytest.approx(sum(want.values()) / 5)


def test_loss_does_not_depend_on_the_partitioning(spark):
    model = ngram.count_ngrams(docs_of(spark, TEXTS).repartition(7), "text", [2])
    a = ngram.example_loss(docs_of(spark, TEXTS).repartition(1), "doc_id", "text", model, 2).collect()
    b = ngram.example_loss(docs_of(spark, TEXTS).repartition(5), "doc_id", "text", model, 2).collect()
    assert dict(map(tuple, a)) == pytest.approx(dict(map(tuple, b)))


def test_probabilities_sum_to_one_at_any_temperature(spark):
    model = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [1, 2])
    for temperature in (0.0, 0.7, 1.0, 5.0):
        rows = ngram.with_temperature(model, temperature)
        sums = rows.groupBy("model_order", "context").agg(F.sum("p").alias("s")).collect()
        assert all(r["s"] == pytest.approx(1.0) for r in sums)
    cold = ngram.with_temperature(model, 0.0).where("model_order = 1").orderBy(F.desc("p")).first()
    assert cold["p"] == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("temperature", [0.0, 0.7, 1.0, 5.0])
@pytest.mark.parametrize("logits", [[1.0, 1.0], [0.5, -1.0, 2.0], [1e4, 0.0, -1e4]])
def test_softmax(spark, logits, temperature):
    scaled = [x / max(temperature, 1e-4) for x in logits]
    exps = [math.exp(x - max(scaled)) for x in scaled]
    df = spark.createDataFrame([(logits,)], "v array<double>")
    got = df.select(softmax(F.col("v"), temperature)).first()[0]
    assert got == pytest.approx([e / sum(exps) for e in exps])


def test_draws_follow_the_counts(spark):
    counts = spark.createDataFrame(
        [(2, c, t, n) for c in range(3000) for t, n in ((1, 1), (5, 2), (9, 5))],
        "model_order int, context bigint, next int, n bigint",
    )
    drawn = {r["next"]: r["count"] for r in ngram.cdf_draw(counts).groupBy("next").count().collect()}
    assert sum(drawn.values()) == 3000
    for token, share in ((1, 1 / 8), (5, 2 / 8), (9, 5 / 8)):
        assert abs(drawn[token] / 3000 - share) < 0.03
    intervals = ngram.cumulative(counts).where("context = 0").orderBy("next").collect()
    assert [(r["lo"], r["hi"]) for r in intervals] == [(0, 1), (1, 3), (3, 8)]


def drawn_shares(spark, counts, temperature, contexts=4000):
    """Tokens drawn in many contexts of the same counts."""
    kind = "double" if isinstance(counts[0], float) else "bigint"
    rows = spark.range(contexts).select(F.lit(2).alias("model_order"), F.col("id").alias("context"))
    tokens = spark.createDataFrame(list(enumerate(counts)), f"next int, n {kind}")
    drawn = ngram.cdf_draw(rows.crossJoin(F.broadcast(tokens)), temperature).groupBy("next").count().collect()
    assert sum(r["count"] for r in drawn) == contexts
    return {r["next"]: r["count"] / contexts for r in drawn}


@pytest.mark.parametrize("temperature", [0.2, 0.7, 5.0])
def test_draws_at_a_temperature_follow_the_softmax(spark, temperature):
    counts = [60 - i for i in range(20)]
    powers = [c ** (1 / temperature) for c in counts]
    shares = drawn_shares(spark, counts, temperature)
    for token, power in enumerate(powers):
        assert abs(shares.get(token, 0) - power / sum(powers)) < 0.03


def test_no_token_of_a_flat_context_loses_its_weight(spark):
    rows = spark.range(50_000).select(
        F.lit(2).alias("model_order"), F.lit(0).cast("bigint").alias("context"), F.col("id").cast("int").alias("next"),
        F.when(F.col("id") == 7, 21).otherwise(20).cast("bigint").alias("n"),
    )
    for temperature in (0.2, 0.7, 3.0):
        weights = ngram.cumulative(rows, temperature).agg(F.min(F.col("hi") - F.col("lo")), F.min("w")).first()
        assert min(weights) > 0
        assert ngram.cdf_draw(rows, temperature).count() == 1


def test_draws_from_example_weights(spark):
    shares = drawn_shares(spark, [0.125, 0.25, 0.625], 1.0)
    assert all(abs(shares[i] - w) < 0.03 for i, w in enumerate([0.125, 0.25, 0.625]))
    model = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [1, 2], weighting="example")
    n = model.select("model_order", "context").distinct().count()
    assert ngram.cdf_draw(model).count() == n


def test_the_weighted_query_returns_its_draws(spark, tmp_path):
    spark.createDataFrame([(1, "adg"), (2, "adgg")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["context"]: r["next"] for r in model_queries.cdf_draw_weighted(spark, str(tmp_path)).collect()}
    assert got.pop(ord("g")) in (ord("g"), 256)
    assert got == {256: ord("a"), ord("a"): ord("d"), ord("d"): ord("g")}


def test_rounds_end_both_ways_to_generate(spark):
    model = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [1, 2])
    prompts = byte_prompts(docs_of(spark, ["ab", "zz", "x" * 30, ""]), "doc_id", "text", 48)
    a, b = (generated(generate(prompts, "doc_id", model, 2, 4, by_rounds=way)) for way in (False, True))
    assert a == b and max(map(len, a.values())) == 4


def test_kernels_in_small_pieces_count_the_same(spark, monkeypatch):
    docs = docs_of(spark, ["abcabcabdabcab" * 9, "", "a", "bcd" * 20, "\u00e9" * 30])
    want = {tuple(r) for r in ngram.tally_ngrams(docs, "text", [1, 2, 3]).select("model_order", "context", "next", "n").collect()}
    counts = ngram.count_ngrams(docs, "text", [2])
    losses = {tuple(r) for r in ngram.example_loss(docs, "doc_id", "text", counts, 2).select("doc_id", F.round("loss", 9)).collect()}
    monkeypatch.setattr(kernels, "PIECE", 16)
    assert want == {tuple(r) for r in ngram.tally_ngrams(docs, "text", [1, 2, 3]).select("model_order", "context", "next", "n").collect()}
    again = ngram.example_loss(docs, "doc_id", "text", counts, 2).select("doc_id", F.round("loss", 9)).collect()
    assert losses == {tuple(r) for r in again}


def test_model_size(spark):
    model = ngram.count_ngrams(docs_of(spark, ["aab"]), "text", [1, 2])
    got = {r["model_order"]: tuple(r)[1:] for r in ngram.model_size(model).collect()}
    assert got == {1: (3, 1, 4), 2: (4, 3, 4)}


def generated(df, key="doc_id"):
    return {r[key]: bytes(r["out"]) for r in df.collect()}


def test_free_generation_follows_a_certain_model(spark):
    model = ngram.count_ngrams(docs_of(spark, ["abc"]), "text", [1, 2, 3])
    for order in (2, 3):
        for block, want in ((2, b"ab"), (3, b"abc"), (16, b"abc")):
            prompts = free_prompts(spark.range(3).withColumnRenamed("id", "doc_id"), "doc_id", block)
            out = generated(generate(prompts, "doc_id", model, order, block))
            assert out == {0: want, 1: want, 2: want}


@pytest.mark.parametrize("order, temperature", [(1, 1.0), (2, 0.7), (5, 0.7), (3, 1.0)])
def test_both_ways_to_generate_agree(spark, order, temperature, monkeypatch):
    model = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [1, 2, 3, 4, 5])
    prompts = byte_prompts(docs_of(spark, ["ab", "zz", "x" * 30, "", "abc"]), "doc_id", "text", 48)
    options = {"temperature": temperature, "end_tag": list(b"ca")}
    want = generated(generate(prompts, "doc_id", model, order, 5, **options))
    assert any(want.values())
    for entries, block in ((1, 2), (1 << 18, 256)):
        monkeypatch.setattr(generation, "HOT_ENTRIES", entries)
        monkeypatch.setattr(generation, "BLOCK_ENTRIES", block)
        assert generated(generate(prompts, "doc_id", model, order, 5, **options, by_rounds=True)) == want


def test_rounds_move_rows_and_not_the_model(spark, monkeypatch):
    """Joins with a cached table of the model neither shuffle nor sort it, and rows leave behind what they have said."""
    seen = []
    attach = generation._Table.attach

    def watched(self, rows, salt):
        out = attach(self, rows, salt)
        seen.append((out._jdf.queryExecution().executedPlan().toString(), self.value))
        return out

    monkeypatch.setattr(generation._Table, "attach", watched)
    model = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [1, 2, 3, 4])
    prompts = byte_prompts(docs_of(spark, ["ab", "zz", "x" * 30, "", "abc"]), "doc_id", "text", 48)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = generated(generate(prompts, "doc_id", model, 4, 7, end_tag=list(b"ca")))
        assert generated(generate(prompts, "doc_id", model, 4, 7, end_tag=list(b"ca"), by_rounds=True)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert seen and {value for _, value in seen} == {"bounds", "steps"}
    for plan, _ in seen:
        # between a cached table and its join lies a filter at most
        lines = plan.splitlines()
        tables = [i for i, line in enumerate(lines) if "+- InMemoryTableScan [_cold_model_order" in line]
        assert tables
        for i in tables:
            above = lines[i - 1] if "Filter" in lines[i - 1] else lines[i]
            assert "Exchange" not in lines[i - 1] and "Sort " not in lines[i - 1]
            if above is not lines[i]:
                assert "Exchange" not in lines[i - 2] and "Sort " not in lines[i - 2]


def test_frequent_contexts_travel_and_others_are_joined(spark, monkeypatch):
    """Of a model that does not travel whole, rows take a round only where they need a context that stays."""
    rounds = []
    attach = generation._Table.attach
    monkeypatch.setattr(generation._Table, "attach", lambda self, *rest: rounds.append(self.value) or attach(self, *rest))
    model = ngram.count_ngrams(docs_of(spark, ["abcd" * 30 + "!", "abcd" * 20, "zqabcd"]), "text", [1, 2, 3, 4])
    prompts = docs_of(spark, ["abc", "zq", "", "yyy"]).withColumn("prompt", byte_ids(F.col("text")))
    asked = prompts.select("doc_id", "prompt", F.lit(12).alias("budget"))
    options = {"temperature": 0.7, "end_tag": list(b"!")}
    want = generated(generate(asked, "doc_id", model, 4, 12, **options))
    assert not rounds and want[0] == b"dabcdabcdabc"
    monkeypatch.setattr(generation, "KERNEL_ENTRIES", model.count() - 1)
    assert generated(generate(asked, "doc_id", model, 4, 12, **options)) == want
    # each of the two tables is asked once in a round, and some row speaks twelve times
    assert 0 < len(rounds) < 12


@pytest.mark.parametrize("order, temperature", [(4, 1.0), (5, 0.7)])
def test_any_part_of_a_model_draws_the_same(spark, order, temperature, monkeypatch):
    model = ngram.count_ngrams(docs_of(spark, TEXTS), "text", [1, 2, 3, 4, 5])
    prompts = byte_prompts(docs_of(spark, ["ab", "zz", "x" * 30, "", "abc"]), "doc_id", "text", 48)
    options = {"temperature": temperature, "end_tag": list(b"ca")}
    want = generated(generate(prompts, "doc_id", model, order, 5, **options))
    size = model.where(F.col("model_order") <= order).count()
    monkeypatch.setattr(generation, "KERNEL_ENTRIES", size // 2)
    assert generated(generate(prompts, "doc_id", model, order, 5, **options)) == want


def test_rows_of_one_key_stay_apart_in_rounds(spark):
    model = ngram.count_ngrams(docs_of(spark, ["abc", "xyz"]), "text", [1, 2, 3])
    rows = spark.createDataFrame([(1, "a"), (1, "x"), (1, "a"), (None, "ab")], "doc_id bigint, text string")
    asked = rows.select("doc_id", byte_ids(F.col("text")).alias("prompt"), F.lit(2).alias("budget"))
    for by_rounds in (False, True):
        out = generate(asked, "doc_id", model, 3, 2, by_rounds=by_rounds).collect()
        assert sorted((r["doc_id"] or 0, bytes(r["out"])) for r in out) == [(0, b"c"), (1, b"bc"), (1, b"bc"), (1, b"yz")]


def test_longest_seen_suffix_by_brute_force(spark):
    """Every token is drawn among those that followed the longest suffix seen in the texts."""
    texts = ["abcd abce bbcf", "xbcd ybce", "abab"]
    model = ngram.count_ngrams(docs_of(spark, texts), "text", [1, 2, 3, 4])
    tokens = lambda t: [256] * 3 + list(t.encode()) + [256]
    for by_rounds in (False, True):
        prompts = docs_of(spark, ["abc", "zbc", "zzc", "zzz", "b", ""]).withColumn("prompt", byte_ids(F.col("text")))
        asked = prompts.select("doc_id", "prompt", F.lit(6).alias("budget"))
        out = {r["doc_id"]: r["out"] for r in generate(asked, "doc_id", model, 4, 6, by_rounds=by_rounds).collect()}
        for r in prompts.collect():
            seen = [256] * 3 + r["prompt"]
            for t in [*out[r["doc_id"]], *([256] if len(out[r["doc_id"]]) < 6 else [])]:
                for k in (3, 2, 1, 0):
                    suffix = seen[len(seen) - k :]
                    follow = {
                        x[i + k] for x in map(tokens, texts) for i in range(3 - k, len(x) - k) if x[i : i + k] == suffix and i + k >= 3
                    }
                    if follow:
                        break
                assert t in follow
                seen.append(t)


def test_a_changed_word_reaches_the_reply(spark):
    """The tags between prompt and reply are one sign, so the prompt's last word is in the context."""
    samples = [f"<|user|> say {w} <|assistant|> {w[::-1]}! <|end|>" for w in ("left", "right", "north")]
    closed = docs_of(spark, samples).withColumn("text", close_turn(F.col("text")))
    prompts = docs_of(spark, ["say left", "say north", "say right"])
    for rows, same in ((byte_prompts(prompts, "doc_id", "text", 64, closed=True), False), (byte_prompts(prompts, "doc_id", "text", 64), True)):
        tails = [r["prompt"][-4:] for r in rows.orderBy("doc_id").collect()]
        assert (len(set(map(tuple, tails))) == 1) == same
    model = ngram.count_ngrams(closed, "text", [1, 2, 3, 4, 5])
    asked = byte_prompts(prompts, "doc_id", "text", 64, closed=True)
    for by_rounds in (False, True):
        out = generated(generate(asked, "doc_id", model, 5, 16, end_tag=list(b"<|end|>"), by_rounds=by_rounds))
        assert out == {0: b"tfel! ", 1: b"htron! ", 2: b"thgir! "}


def test_an_empty_model_says_nothing(spark):
    model = ngram.count_ngrams(docs_of(spark, []), "text", [1, 2])
    prompts = byte_prompts(docs_of(spark, ["ab"]), "doc_id", "text", 48)
    assert generated(generate(prompts, "doc_id", model, 2, 4)) == {0: b""}


def test_budgets(spark):
    """The frame of an empty prompt has 24 bytes; a prompt that fills the block leaves nothing."""
    frame = len("<|user|>  <|assistant|>")
    prompts = docs_of(spark, ["", "abc", "x" * 100])
    rows = byte_prompts(prompts, "doc_id", "text", 64).orderBy("doc_id").collect()
    assert [r["budget"] for r in rows] == [63 - frame, 60 - frame, 0]
    assert bytes(rows[2]["prompt"]) == (b"<|user|> " + b"x" * 100 + b" <|assistant|>")[-63:]
    model = ngram.count_ngrams(docs_of(spark, ["z" * 500]), "text", [1, 2])
    out = generated(generate(byte_prompts(prompts, "doc_id", "text", 64), "doc_id", model, 2, 64))
    assert len(out[2]) == 0 and 0 < len(out[0]) <= 63 - frame
    tokens = spark.createDataFrame([(0, [1, 2]), (1, [1] * 20), (2, [])], "id int, ids array<int>")
    got = {r["id"]: (len(r["prompt"]), r["budget"]) for r in token_prompts(tokens, "id", "ids", 16, 5).collect()}
    assert got == {0: (2, 5), 1: (15, 1)}
    with pytest.raises(ValueError):
        token_prompts(tokens, "id", "ids", 16, 0)


def test_end_tag_is_cut_off(spark):
    model = ngram.count_ngrams(docs_of(spark, ["hi<|end|>"]), "text", [1, 2, 3, 4])
    prompts = free_prompts(spark.range(2).withColumnRenamed("id", "doc_id"), "doc_id", 30)
    out = generated(generate(prompts, "doc_id", model, 4, 30, end_tag=list(b"<|end|>")))
    assert set(out.values()) == {b"hi"}


def test_log_and_best_order(spark):
    docs = docs_of(spark, ["abcabc" * n for n in range(1, 31)])
    log = eval_log(docs, "doc_id", "text", [1, 2, 3])
    rows = {r["model_order"]: r for r in log.collect()}
    assert rows[1]["val_loss"] > rows[2]["val_loss"]
    assert best_order(log).first()["model_order"] in (2, 3)
    single = eval_log(docs_of(spark, ["ab"]), "doc_id", "text", [1])
    assert single.first()["val_loss"] is None
    assert best_order(single).first()["model_order"] == 1


NAN = float("nan")


def test_best_of_a_log(spark):
    log = spark.createDataFrame(
        [(1, NAN), (2, 3.0), (3, 2.0), (4, 2.0), (5, 2.5), (6, None), (7, 1.0)], "step int, loss double"
    )
    got = improvements(log, "loss").orderBy("step").collect()
    assert [r["improved"] for r in got] == [False, True, True, False, False, False, True]
    assert best_model(log.where("step < 7"), "loss").first()["step"] == 3
    assert best_model(log.where("step = 1"), "loss").count() == 0


def test_steps_and_batches(spark):
    log = spark.createDataFrame([(i, float(i)) for i in range(1, 12)], "step int, loss double")
    assert sorted(r["step"] for r in eval_steps(log, 5).collect()) == [5, 10, 11]
    with pytest.raises(ValueError):
        eval_steps(log, 0)
    draws = log.select((F.col("step") - 1).alias("draw"), "loss")
    got = {r["batch_id"]: r["loss"] for r in batch_loss(draws, "draw", 4).collect()}
    assert got == {0: 2.5, 1: 6.5, 2: 10.0}
    with pytest.raises(ValueError):
        batch_loss(draws, "draw", 0)


def test_metric_prefers_validation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, NAN), (1.0, None), (NAN, NAN)], "t double, v double")
    got = [r[0] for r in df.select(selection_metric(F.col("t"), F.col("v"))).collect()]
    assert got == [2.0, 1.0, 1.0, None]


def test_sweep(spark):
    losses = spark.createDataFrame([(1, True, 4.0), (1, False, 2.0), (2, True, 1.0)], "a int, b boolean, loss double")
    got = {(r["a"], r["b"]): (r["n"], r["loss"]) for r in sweep_summary(losses, ["a", "b"]).collect()}
    assert got[None, None] == (3, pytest.approx(7 / 3))
    assert got[1, None] == (2, 3.0) and got[None, True] == (2, 2.5) and got[2, True] == (1, 1.0)
    assert len(got) == 8


def peak_mb(kernel, batch):
    """Peak MB of a kernel over one batch, each result dropped as it comes."""
    tracemalloc.start()
    try:
        for _ in kernel(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def large_batch():
    """4 MB of text in rows of 20 kB, of few distinct bytes."""
    letters = np.random.default_rng(1).integers(97, 123, (200, 20_000), np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([row.tobytes().decode() for row in letters])], ["text"])


def test_counting_needs_little_memory_beside_its_batch():
    """However large a batch is, pairs are counted a bounded piece at a time."""
    assert peak_mb(kernels.ngram_batches([2], 257, 256, 256, 0), large_batch()) < 50


def test_counting_many_orders_needs_little_memory_too():
    """As above, for the five orders of the chat model."""
    orders = model_queries.CHAT_ORDERS
    assert peak_mb(kernels.ngram_batches(orders, 257, 256, 256, 0), large_batch()) < 80
