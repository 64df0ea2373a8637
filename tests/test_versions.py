"""Appends that can be resumed: token files, logs and models by versions; what was observed while counting."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import byte_ids
from lexiloom.operators.ngram import BYTES, count_ngrams
from lexiloom.operators.order import split_tail
from lexiloom.operators.vocab import encoded_stats
from lexiloom.plans.train import eval_log, measured_log
from lexiloom.sources.logs import EVALUATIONS, LOSSES, append_steps, read_steps
from lexiloom.sources.model_store import append_model, load_model, save_model
from lexiloom.sources.token_files import (
    append_tokens,
    explode_tokens,
    read_tokens,
    token_count,
    token_sums,
    token_windows,
    write_tokens,
)
from lexiloom.sources.versions import append_version, read_versions, versions

RUNS = "first_idx bigint, tokens array<int>"


def run_of(spark, *runs):
    rows, at = [], 0
    for run in runs:
        rows.append((at, list(run)))
        at += len(run)
    return spark.createDataFrame(rows, RUNS)


def tokens_of(spark, path, version=None):
    rows = explode_tokens(read_tokens(spark, path, version=version)).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(len(rows)))
    return [r["token"] for r in rows]


def test_appended_tokens_continue_the_index(spark, tmp_path):
    path = str(tmp_path / "t.bin")
    write_tokens(run_of(spark, range(0, 30), range(30, 55)), path, tokens_per_part=20)
    assert append_tokens(run_of(spark, range(55, 80), range(80, 100)), path, tokens_per_part=20) == 1
    assert append_tokens(spark.createDataFrame([], RUNS), path) == 2
    assert append_tokens(run_of(spark, range(100, 103)), path) == 3
    assert tokens_of(spark, path) == list(range(103)) and token_count(path) == 103
    assert [len(tokens_of(spark, path, v)) for v in (0, 1, 2, 3)] == [55, 100, 100, 103]
    draws = spark.createDataFrame([(1, 50, 9), (2, 96, 6)], "draw int, start_idx bigint, n bigint")
    got = {r["draw"]: r["tokens"] for r in token_windows(draws, "draw", path).collect()}
    assert got == {1: list(range(50, 60)), 2: list(range(96, 103))}


def test_a_failed_append_leaves_the_file_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t.bin")
    write_tokens(run_of(spark, [1, 2, 3]), path)
    with pytest.raises(Exception, match="out of range"):
        append_tokens(run_of(spark, [4, 70_000]), path)
    assert tokens_of(spark, path) == [1, 2, 3]
    assert append_tokens(run_of(spark, [4, 5]), path) == 1
    assert tokens_of(spark, path) == [1, 2, 3, 4, 5]
    (tmp_path / "plain.bin").write_bytes(b"\1\0")
    with pytest.raises(ValueError):
        append_tokens(run_of(spark, [4]), str(tmp_path / "plain.bin"))


def test_sums_of_ranges(spark):
    runs = run_of(spark, range(5, 12), [], range(100, 123), [60_000])
    got = {tuple(r) for r in token_sums(runs.repartition(3), 10).collect()}
    flat = [*range(5, 12), *range(100, 123), 60_000]
    want = set()
    for part in range(4):
        run = flat[part * 10 : part * 10 + 10]
        want.add((part, len(run), sum(run), sum(i * t for i, t in enumerate(run))))
    assert got == want
    assert token_sums(spark.createDataFrame([], RUNS), 10).collect() == []


def test_a_resumed_log_holds_each_step_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_steps(spark, path).collect() == []
    log = spark.createDataFrame([(1, 3.0), (2, 2.5), (2, 2.75), (3, float("nan"))], LOSSES)
    append_steps(log, path, "a")
    append_steps(log.where("step = 1"), path, "b")
    append_steps(spark.createDataFrame([(3, 2.0), (4, None)], LOSSES), path, "a")
    got = [tuple(r) for r in read_steps(spark, path).orderBy("run", "step").collect()]
    assert got == [("a", 1, 3.0), ("a", 2, 2.75), ("a", 3, 2.0), ("a", 4, None), ("b", 1, 3.0)]
    before = read_steps(spark, path, upto=1).orderBy("step").collect()
    assert [r["step"] for r in before] == [1, 2, 3] and before[2]["loss"] != before[2]["loss"]


def test_log_columns_may_come_in_any_order(spark, tmp_path):
    log = spark.createDataFrame([(1e-3, None, 2.0, 7, "x")], "lr double, val_loss double, train_loss double, step int, note string")
    append_steps(log, str(tmp_path / "log"), "a", EVALUATIONS)
    row = read_steps(spark, str(tmp_path / "log"), EVALUATIONS).first()
    assert tuple(row) == ("a", 7, 2.0, None, 1e-3)


def test_versions_without_success_do_not_count(spark, tmp_path):
    path = str(tmp_path / "v")
    assert append_version(spark.range(3), path) == 1
    broken = Path(path) / "version=2"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert versions(path) == [1]
    assert append_version(spark.range(2), path) == 3
    rows = read_versions(spark, path, "id bigint").groupBy("version").count().collect()
    assert {tuple(r) for r in rows} == {(1, 3), (3, 2)}
    assert read_versions(spark, path, "id bigint", upto=2).count() == 3


@pytest.mark.parametrize("weighting", ["token", "example"])
def test_counts_are_added_to_a_model(spark, tmp_path, weighting):
    docs = spark.createDataFrame([(i, "the lamp " * (i % 4) + "x") for i in range(20)], "doc_id int, text string")
    config = {"model_order": 2, "base": BYTES.base, "weighting": weighting}
    path = str(tmp_path / "model")
    save_model(count_ngrams(docs.where("doc_id < 7"), "text", [2], weighting=weighting), config, path)
    for low, high in ((7, 8), (8, 20)):
        part = docs.where(f"doc_id >= {low} AND doc_id < {high}")
        append_model(count_ngrams(part, "text", [2], weighting=weighting), config, path)
    got = {tuple(r)[:3]: r["n"] for r in load_model(spark, path, config).collect()}
    want = {tuple(r)[:3]: r["n"] for r in count_ngrams(docs, "text", [2], weighting=weighting).collect()}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="model_order"):
        append_model(count_ngrams(docs, "text", [2]), {**config, "model_order": 3}, path)


def test_what_is_observed_while_counting(spark):
    docs = spark.createDataFrame([(i, "abc" * (i % 5)) for i in range(40)], "doc_id int, text string")
    log = {r["step"]: r for r in measured_log(docs, "doc_id", "text", [1, 3]).collect()}
    plain = {r["model_order"]: r for r in eval_log(docs, "doc_id", "text", [1, 3]).collect()}
    train = split_tail(docs, "doc_id").where("split = 'train'")
    targets = train.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert set(log) == {1, 3}
    for step, row in log.items():
        assert (row["n_examples"], row["n_targets"]) == (36, targets)
        assert row["n_entries"] == count_ngrams(train, "text", [step]).count()
        assert row["seconds"] > 0 and row["targets_per_sec"] == pytest.approx(targets / row["seconds"])
        assert row["train_loss"] == pytest.approx(plain[step]["train_loss"])
        assert row["val_loss"] == pytest.approx(plain[step]["val_loss"])


def test_nothing_to_count(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    row = measured_log(docs, "doc_id", "text", [1]).first()
    assert (row["n_examples"], row["n_targets"], row["n_entries"], row["train_loss"]) == (0, 0, 0, None)


def test_stats_of_encoded_texts(spark):
    rows = [("a", [1, 2], "xyz"), ("a", [], ""), ("b", [], ""), ("a", [3], "é")]
    df = spark.createDataFrame(rows, "split string, tokens array<int>, text string")
    got = {r["split"]: tuple(r)[1:] for r in encoded_stats(df, "split", "tokens", "text").collect()}
    assert got == {"a": (3, 3, 0, 2, 5, pytest.approx(5 / 3)), "b": (1, 0, 0, 0, 0, None)}


def test_bytes_are_written_and_appended_as_ids(spark, tmp_path):
    """A stream of bytes makes the file that the stream of their ids makes."""
    texts = spark.createDataFrame([(0, "ab\u00e9"), (4, ""), (4, "xyz"), (9, "\u65e5"), (12, None)], "first_idx bigint, text string")
    data = texts.select("first_idx", F.encode("text", "UTF-8").alias("tokens"))
    ids = texts.select("first_idx", byte_ids(F.encode("text", "UTF-8")).alias("tokens"))
    found = []
    for name, stream in (("bytes", data), ("ids", ids)):
        path = f"{tmp_path}/{name}"
        write_tokens(stream, path, tokens_per_part=4)
        append_tokens(stream, path, tokens_per_part=4)
        found.append(sorted(map(tuple, explode_tokens(read_tokens(spark, path)).collect())))
    assert found[0] == found[1] and len(found[0]) == 20
