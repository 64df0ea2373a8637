from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import byte_ids, utf8
from lexiloom.operators import vocab
from lexiloom.operators.examples import doc_examples, explode_examples
from lexiloom.operators.order import shuffled
from lexiloom.operators.synth import PART_WEIGHTS, TOPICS, part_rows, prompt_rows, reply_rows, synth_chat
from lexiloom.operators.token_stream import sample_windows, stream_blocks, token_stream, window_draws

TEXTS = ["abc", "", "é€", "a\x00\U0001f600b", "zzz"]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_vocabulary_is_over_bytes_with_the_marker_last(spark):
    rows = vocab.byte_vocab(docs_of(spark, TEXTS)).orderBy("token_id").collect()
    data = "".join(TEXTS).encode()
    assert [r["byte"] for r in rows] == [*sorted(set(data)), None]
    assert [r["token_id"] for r in rows] == list(range(len(set(data)) + 1))
    assert [r["n"] for r in rows[:-1]] == [data.count(b) for b in sorted(set(data))]


def test_counts_per_group(spark):
    docs = docs_of(spark, ["aab", "b", "ac"]).withColumn("g", F.col("doc_id") % 2)
    got = {(r["g"], chr(r["byte"])): r["n"] for r in vocab.byte_counts(docs, by="g").collect()}
    assert got == {(0, "a"): 3, (0, "b"): 1, (0, "c"): 1, (1, "b"): 1}


def test_encoding_and_decoding_are_inverse(spark):
    docs = docs_of(spark, TEXTS)
    ids = vocab.byte_vocab(docs)
    encoded = vocab.encode_bytes(docs, ids)
    rank = {b: i for i, b in enumerate(sorted(set("".join(TEXTS).encode())))}
    for r in vocab.decode_bytes(encoded, ids).collect():
        assert r["tokens"] == [rank[b] for b in r["text"].encode()]
        assert bytes(r["data"]).decode() == r["text"]


def test_unknown_bytes_reject_a_prompt(spark):
    ids = vocab.byte_vocab(docs_of(spark, ["abc"]))
    prompts = docs_of(spark, ["cab", "abd", "é"])
    found = vocab.unsupported_bytes(prompts, ids, "doc_id").collect()
    assert sorted((r["doc_id"], r["byte"]) for r in found) == [(1, 0x64), (2, 0xA9), (2, 0xC3)]
    kept = vocab.reject_unsupported(prompts, ids, "doc_id").collect()
    assert [r["doc_id"] for r in kept] == [0]
    assert vocab.encode_bytes(prompts, ids).where("doc_id = 1").first()["tokens"] == [0, 1, None]


@pytest.mark.parametrize("length", [1, 6, 7, 8, 9, 100])
@pytest.mark.parametrize("block", [None, 8])
def test_examples(spark, length, block):
    tokens = list(range(length))
    df = spark.createDataFrame([(tokens,)], "tokens array<int>")
    row = doc_examples(df, "tokens", F.lit(-1), block).first()
    n = length + 1 if block is None else min(length + 1, block)
    assert row["inputs"] == [-1, *tokens][:n]
    assert row["targets"] == [*tokens, -1][:n]
    exploded = explode_examples(doc_examples(df, "tokens", F.lit(-1), block))
    assert exploded.count() == n


@pytest.mark.parametrize("total", [2, 8, 9, 10, 200])
def test_windows_from_the_stream(spark, total):
    """Windows of 8 tokens at every start, over documents of many lengths (one spans many blocks)."""
    block, sizes, left = 8, [], total
    for n in [1, 0, 5, 90, 2, 7, 1000]:
        sizes.append(min(n, left))
        left -= sizes[-1]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, n int").where("n > 0")
    docs = docs.withColumn("tokens", F.transform(F.sequence(F.lit(1), "n"), lambda i: F.col("doc_id") * 1000 + i))
    stream = token_stream(docs, "doc_id", F.size("tokens"))
    flat = [t for r in stream.orderBy("first_idx").collect() for t in r["tokens"]]
    assert len(flat) == total
    blocks = stream_blocks(stream, "tokens", block)
    n = min(block, total - 1)
    starts = [(i, i, n) for i in range(total - n)]
    draws = spark.createDataFrame(starts, "draw int, start_idx bigint, n bigint")
    for r in sample_windows(blocks, draws, "draw", block).collect():
        assert r["tokens"] == flat[r["start_idx"] : r["start_idx"] + n + 1]
    assert sample_windows(blocks, draws, "draw", block).count() == len(starts)


def test_window_starts_cover_all_and_only_the_fits(spark):
    draws = window_draws(spark.range(2000), "id", F.lit(12).cast("bigint"), 8, 1).collect()
    assert {r["n"] for r in draws} == {8}
    assert {r["start_idx"] for r in draws} == {0, 1, 2, 3}
    short = window_draws(spark.range(5), "id", F.lit(3).cast("bigint"), 8, 1).collect()
    assert {(r["start_idx"], r["n"]) for r in short} == {(0, 2)}
    assert window_draws(spark.range(5), "id", F.lit(1).cast("bigint"), 8, 1).count() == 0


def test_stream_with_end_tokens_and_per_split(spark):
    docs = spark.createDataFrame([(i, i % 4, "ab"[i % 2]) for i in range(50)], "doc_id int, n int, split string")
    plain = token_stream(docs, "doc_id", F.col("n"), eos=True).agg(F.max("last_idx")).first()[0]
    assert plain + 1 == sum(i % 4 + 1 for i in range(50))
    for split, group in (("a", range(0, 50, 2)), ("b", range(1, 50, 2))):
        rows = token_stream(docs, "doc_id", F.col("n"), by=("split",)).where(F.col("split") == split).collect()
        places = [i for r in rows for i in range(r["first_idx"], r["last_idx"] + 1)]
        assert sorted(places) == list(range(sum(i % 4 for i in group)))


def test_stream_order_is_the_shuffle(spark):
    docs = spark.range(40).withColumn("n", F.lit(3))
    first = [r["id"] for r in token_stream(docs, "id", F.col("n")).orderBy("first_idx").collect()]
    assert first == [r["id"] for r in shuffled(docs, "id").orderBy("pos").collect()]


def test_corpus_stats(spark):
    docs = docs_of(spark, ["ab", "é", "a"]).withColumn("split", F.when(F.col("doc_id") < 2, "train").otherwise("val"))
    got = {r["split"]: tuple(r)[1:] for r in vocab.corpus_stats(docs).collect()}
    assert got == {"train": (2, 4, 5), "val": (1, 1, 5), "all": (3, 5, 5)}


def test_generated_samples(spark):
    n = 22_000
    rows = synth_chat(spark.range(n), "id")
    assert rows.count() == n
    prompts, replies = {}, {}
    for part, _, text in prompt_rows():
        prompts.setdefault(part, set()).add(text)
    for part, _, text in reply_rows():
        replies.setdefault(part, set()).add(text)
    seen = rows.select("topic", "part", "user", "assistant").distinct().collect()
    for r in seen:
        assert r["part"] in TOPICS[r["topic"]]
        assert r["user"] in prompts[r["part"]] and r["assistant"] in replies[r["part"]]
    assert {r["user"] for r in seen} == set.union(*prompts.values())
    assert {r["assistant"] for r in seen} == set.union(*replies.values())
    assert "{" not in "".join(t for s in replies.values() for t in s)
    by_topic = {r["topic"]: r["count"] for r in rows.groupBy("topic").count().collect()}
    assert len(by_topic) == len(TOPICS) and all(abs(c - n / len(TOPICS)) < 200 for c in by_topic.values())
    nested = next(i for i, parts in enumerate(TOPICS) if len(parts) > 1)
    parts = {r["part"]: r["count"] for r in rows.where(F.col("topic") == nested).groupBy("part").count().collect()}
    for part, weight in zip(TOPICS[nested], PART_WEIGHTS[len(TOPICS[nested])]):
        assert abs(parts[part] / by_topic[nested] - weight / sum(PART_WEIGHTS[len(TOPICS[nested])])) < 0.06
    assert part_rows()[-1][1] == sum(sum(PART_WEIGHTS[len(parts)]) for parts in TOPICS)


def test_long_texts_are_encoded_whole(spark):
    docs = docs_of(spark, ["xy" * 300_000])
    tokens = vocab.encode_bytes(docs, vocab.byte_vocab(docs)).select(F.size("tokens"), F.array_max("tokens")).first()
    assert tuple(tokens) == (600_000, 1)
    assert docs.select(F.size(byte_ids(utf8(F.col("text"))))).first()[0] == 600_000


def test_next_token_counts_stay_within_rows(spark):
    from collections import Counter

    from lexiloom.operators.examples import next_token_counts

    rows = [[1, 2, 1, 2, 2], [2**31 - 1, 0], [7], [], None, [1, 2]]
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, tokens array<int>")
    want = Counter(p for r in rows if r for p in zip(r, r[1:]))
    assert {(r["token"], r["next_token"]): r["n"] for r in next_token_counts(docs).collect()} == dict(want)
    assert next_token_counts(docs.limit(0)).count() == 0
