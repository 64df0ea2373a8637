from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import chat
from lexiloom.plans.train import Options, looks_like_chat
from lexiloom.sources.pairs import chat_pairs, choose_splits
from lexiloom.sources.samples import read_samples, write_samples


def im(user, assistant):
    return f"<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n{assistant}<|im_end|>"


def test_frames(column):
    assert column(["Hi\nYou "], chat.legacy_prompt(F.col("t"))) == ["<|user|> hi you  <|assistant|>"]
    assert column([" Hi\nYou "], chat.im_prompt(F.col("t"))) == [
        "<|im_start|>user\nhi you<|im_end|>\n<|im_start|>assistant\n"
    ]
    assert column(["u"], chat.legacy_sample(F.col("t"), F.lit("a"))) == ["<|user|> u <|assistant|> a <|end|>"]
    assert column(["u"], chat.im_sample(F.col("t"), F.lit("a"))) == [im("u", "a")]


def test_legacy_conversion(column):
    cases = {
        "plain text": "plain text",
        "<|user|> only": "<|user|> only",
        "<|user|> Hi  There <|assistant|>\tYES <|end|> rest": im("hi there", "yes"),
        "<|user|> a <|assistant|> b": im("a", "b"),
        "x <|user|> a <|user|> b <|assistant|> c <|assistant|> d <|end|>": im("a <|user|> b", "c <|assistant|> d"),
        "<|assistant|> early <|user|> late": None,
        "<|assistant|> e <|user|> u <|assistant|> a <|end|>": im("u", "a"),
        "<|user|><|assistant|>": im("", ""),
    }
    assert column(list(cases), chat.convert_legacy(F.col("t"))) == list(cases.values())


def test_replies_of_a_run(column):
    outputs = ["you> x\nbot>  Hi THERE \nbot> no", "bot> ", "nothing", "xbot> a\r\nbot> B", "you> bot> a"]
    assert column(outputs, chat.first_reply(F.col("t"), "bot> ")) == ["hi there", "", None, "b", None]
    ids = ["ids> 1 2\nids> 3  4\n", "ids>", "x ids> 1", "ids> 5\nother"]
    assert column(ids, chat.last_reply_ids(F.col("t"), "ids>")) == [[3, 4], [], None, [5]]


def test_reply_cleaning(column):
    replies = [" <pad> hi<|im_start|>you <|im_end|> no", "<|im_end|>", "plain"]
    assert column(replies, chat.clean_reply(F.col("t"))) == ["hi you", "", "plain"]
    assert column(["a <|end|> b <|end|>", "c"], chat.cut_at_end_tag(F.col("t"))) == ["a ", "c"]


def test_pairs_are_adjacent_turns(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
        (2, 0, "assistant", "a"), (2, 1, "user", "u"), (2, 2, "user", "v"), (2, 3, "assistant", "b"),
    ]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    assert sorted(tuple(r) for r in chat_pairs(df).collect()) == [(1, 1, "u1", "a1"), (2, 2, "v", "b")]


@pytest.mark.parametrize("names, kept", [(["train", "test", "validation"], "test"), (["train", "validation"], "validation")])
def test_evaluation_split_falls_back_to_validation(spark, names, kept):
    df = spark.createDataFrame([(n, n) for n in names], "split string, origin string")
    assert sorted(tuple(r) for r in choose_splits(df).collect()) == [("eval", kept), ("train", "train")]


def test_samples_survive_their_line_breaks(spark, tmp_path):
    samples = spark.createDataFrame([(im("a", "b"),), (im("c", "d"),)], "sample string")
    path = str(tmp_path / "samples")
    write_samples(samples, path)
    assert sorted(r["sample"] for r in read_samples(spark, path).collect()) == [im("a", "b"), im("c", "d")]
    assert spark.read.text(path).count() > 2


def test_chat_detection_reads_eight_shuffled_documents(spark):
    plain = [(i, "plain") for i in range(8)]

    def detect(rows):
        return looks_like_chat(spark.createDataFrame(rows, "id int, text string"), "id", "text").first()[0]

    assert detect(plain) is False
    assert detect([(0, "<|user|> x <|assistant|> y")]) is True
    assert detect([(0, "<|user|> x")]) is False
    assert detect([(0, "<|im_start|> assistant")]) is True
    framed = [detect(plain + [(i, "<|im_start|>assistant")]) for i in range(8, 40)]
    assert True in framed and False in framed


def test_options():
    assert Options().for_corpus(True) == Options(128, 1e-3)
    assert Options(256, 1e-4).for_corpus(True) == Options(256, 1e-4)
    assert Options().for_corpus(False) == Options()
    for bad in ({"block": 0}, {"rate": 0.0}, {"batch": -1}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_pairs_follow_the_order_of_turns_not_their_numbers(spark, monkeypatch):
    from lexiloom.sources import pairs

    rows = [
        (1, 1, "user", "a"), (1, 3, "assistant", "b"), (1, 7, "user", "c"), (1, 8, "user", "d"), (1, 20, "assistant", "e"),
        (2, 0, "system", "s"), (2, 1, "user", "f"), (2, 2, "system", "t"), (2, 3, "assistant", "g"), (3, 5, "user", "h"),
        (4, 1, "assistant", "i"), (4, 1, "user", "j"), (4, 2, "assistant", "k"), (4, 2, "assistant", "l"), (5, 1, "user", None), (5, 2, "assistant", "m"),
    ]
    want = {(1, 1, "a", "b"), (1, 8, "d", "e"), (4, 1, "j", "k")}
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    for width in (4096, 2, 1):
        monkeypatch.setattr(pairs, "RANGE", width)
        assert {tuple(r) for r in pairs.chat_pairs(turns).collect()} == want


def test_samples_that_hold_the_separator(spark, tmp_path):
    df = spark.createDataFrame([("k", "train", "a\x1eb"), ("l", "eval", "c")], "key string, split string, sample string")
    write_samples(df, str(tmp_path / "p"), form="parquet")
    assert sorted(map(tuple, read_samples(spark, str(tmp_path / "p"), form="parquet").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="separator"):
        write_samples(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        write_samples(df, str(tmp_path / "x"), form="csv")


def test_pairs_of_conversations_without_an_id(spark, monkeypatch):
    from lexiloom.sources import pairs

    turns = spark.createDataFrame(
        [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (None, None, "user", "c"), (3, 1, "user", "d")],
        "conv_id int, turn int, role string, text string",
    )
    for width in (1, 4096):
        monkeypatch.setattr(pairs, "RANGE", width)
        assert [tuple(r) for r in pairs.chat_pairs(turns).collect()] == [(None, 1, "a", "b")]
    assert pairs.chat_pairs(turns.limit(0)).count() == 0
