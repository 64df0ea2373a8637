"""Physical plans: no pair products, no corpus-size window in one task, scans of the needed columns."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as registry
from lexiloom.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


def plan_of(spark, name):
    df = registry.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().toString()


# Learning merges runs its rounds when it is called; their plans are not those of the result.
LAZY = sorted(
    set(QUERIES) - {"bpe_merges", "bpe_encode", "bpe_roundtrip", "answer_prompts", "token_windows", "token_window_loss"}
)


# Windows without a partition run over at most 256 bytes or one total per bucket.
SMALL_ORDERS = {"b", "byte", "_bucket"}


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_products_and_no_large_window_in_one_task(spark, name):
    physical = plan_of(spark, name).split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in physical
    assert "BroadcastNestedLoopJoin" not in physical
    assert "windowspecdefinition(specifiedwindowframe" not in physical
    unpartitioned = re.findall(r"windowspecdefinition\((\w+)#\d+L? (?:ASC|DESC)", physical)
    assert set(unpartitioned) <= SMALL_ORDERS


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("split_head", "documents", {"doc_id"}),
        ("shuffle_order", "documents", {"doc_id"}),
        ("token_stream", "documents", {"doc_id", "text"}),
        ("synth_chat", "events", {"event_id"}),
        ("rms_norm", "embeddings", {"vec_id", "embedding"}),
        ("chat_pairs", "conversations", {"conv_id", "turn", "role", "text"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, table, columns):
    physical = plan_of(spark, name).split("== Physical Plan ==")[1]
    scans = re.findall(rf"{table}\.parquet.*?ReadSchema: struct<([^\n]*?)>(?:\n|$|\s)", physical)
    assert scans
    for scan in scans:
        assert {c.split(":")[0] for c in re.split(r",(?=\w+:)", scan) if c} <= columns


def test_filters_reach_the_scan(spark):
    physical = plan_of(spark, "style_ok").split("== Physical Plan ==")[1]
    assert "EqualTo(role,assistant)" in physical


def test_windows_join_on_ranges_and_texts_on_their_key(spark):
    physical = plan_of(spark, "sample_windows").split("== Physical Plan ==")[1]
    joins = set(re.findall(r"(?:Hash|SortMerge)Join \[(\w+)#", physical))
    # documents and draws by ranges of the stream, texts by their key, carried totals by bucket
    assert joins == {"_range", "doc_id", "_bucket"}


@pytest.mark.parametrize("name, source", [("best_so_far", "documents"), ("score_history", "conversations")])
def test_running_values_read_a_stored_log(spark, name, source):
    physical = plan_of(spark, name).split("== Physical Plan ==")[1]
    assert 0 < physical.count("FileScan") < 20
    assert f"{source}.parquet" not in physical


def test_pairing_moves_texts_once(spark):
    """Windows and join share one key; what else is shuffled is one row per range."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        lines = plan_of(spark, "chat_pairs").split("== Physical Plan ==")[1].splitlines()
    finally:
        spark.conf.set(threshold, before)
    join = next(i for i, line in enumerate(lines) if re.search(r"(Hash|SortMerge)Join \[_at", line))
    window = next(i for i, line in enumerate(lines) if "Window [lead(" in line)
    # the texts reach the join in the partitioning of their window
    assert join < window and not any("Exchange" in line for line in lines[join:window])
