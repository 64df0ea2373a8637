from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators.ngram import BYTES, count_ngrams
from lexiloom.operators.token_stream import token_stream
from lexiloom.plans.evaluate import evaluate, token_alphabet
from lexiloom.plans.prepare import framed, prepare
from lexiloom.operators.bpe import Tokenizer
from lexiloom.operators.evaluate import case_table
from lexiloom.sources import token_files
from lexiloom.sources.corpus import read_corpus
from lexiloom.sources.lines import FALLBACK_LINES
from lexiloom.sources.logs import EVALUATIONS, read_log, write_log
from lexiloom.sources.metadata import int_field, meta_document, meta_fields, storage_type, string_field
from lexiloom.sources.model_store import load_model, save_model
from lexiloom.sources.samples import read_samples
from lexiloom.sources.token_files import explode_tokens, load_corpus, read_tokens, sidecars, token_windows, write_tokens


def stream_of(spark, sizes, top=60_000):
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, n int").where("n > 0")
    tokens = F.transform(F.sequence(F.lit(1), "n"), lambda i: F.pmod(F.col("doc_id") * 7919 + i, F.lit(top)))
    return token_stream(docs.withColumn("tokens", tokens), "doc_id", F.size("tokens"))


def flat(stream):
    return [t for r in stream.orderBy("first_idx").collect() for t in r["tokens"]]


@pytest.mark.parametrize("dtype", ["u16", "u32"])
def test_tokens_survive_files(spark, tmp_path, dtype, monkeypatch):
    monkeypatch.setattr(token_files, "TOKENS_PER_RANGE", 64)
    stream = stream_of(spark, [5, 300, 1, 0, 77, 250, 3])
    path = str(tmp_path / "train.bin")
    write_tokens(stream, path, dtype, tokens_per_part=100)
    want = flat(stream)
    manifest = json.loads((tmp_path / "train.bin" / "_parts.json").read_text())
    joined = b"".join((tmp_path / "train.bin" / name).read_bytes() for name, _, _ in manifest["parts"])
    assert np.frombuffer(joined, token_files.DTYPES[dtype]).tolist() == want
    rows = explode_tokens(read_tokens(spark, path)).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(len(want)))
    assert [r["token"] for r in rows] == want


def test_plain_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "TOKENS_PER_RANGE", 10)
    path = tmp_path / "tokens.bin"
    np.arange(35, dtype="<u2").tofile(path)
    tokens = read_tokens(spark, str(path))
    assert tokens.rdd.getNumPartitions() == 4
    assert sorted(r["token"] for r in explode_tokens(tokens).collect()) == list(range(35))


def test_files_of_odd_length_are_rejected(spark, tmp_path):
    path = tmp_path / "odd.bin"
    path.write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        read_tokens(spark, str(path)).collect()


def test_ids_out_of_range_are_rejected(spark, tmp_path):
    stream = spark.createDataFrame([(0, [1, 65_536])], "first_idx bigint, tokens array<int>")
    with pytest.raises(Exception, match="out of range"):
        write_tokens(stream, str(tmp_path / "x.bin"))
    write_tokens(stream, str(tmp_path / "y.bin"), "u32")
    assert flat(read_tokens(spark, str(tmp_path / "y.bin"))) == [1, 65_536]


def test_sidecars():
    assert sidecars("a/b/train.bin") == ("a/b/eval.bin", "a/b/meta.json")
    assert sidecars("train.bin") == ("./eval.bin", "./meta.json")
    assert token_files.is_token_corpus("x/train.bin") and not token_files.is_token_corpus("x/corpus.txt")


META = {"dtype": "u16", "vocab_size": 9, "special_tokens": {"pad_id": 0, "im_start_id": 1, "im_end_id": 2}}


def corpus_at(spark, path, meta, train=20, held=5):
    path.mkdir()
    (path / "meta.json").write_text(json.dumps(meta, indent=2))
    np.arange(train, dtype="<u2").tofile(path / "train.bin")
    np.arange(held, dtype="<u2").tofile(path / "eval.bin")
    return str(path / "train.bin")


def test_token_corpora_are_checked(spark, tmp_path):
    tokens, meta = load_corpus(spark, corpus_at(spark, tmp_path / "good", META))
    assert (meta["vocab_size"], meta["user_id"], meta["end_id"], meta["assistant_id"]) == (9, 1, 2, -1)
    stats = {r["split"]: tuple(r)[1:] for r in token_files.corpus_stats(tokens).collect()}
    assert stats == {"train": (20, 0, 19, 190), "eval": (5, 0, 4, 10)}
    for name, bad in (("u32", {**META, "dtype": "u32"}), ("none", {"dtype": "u16"}), ("zero", {**META, "vocab_size": 0})):
        with pytest.raises(ValueError):
            load_corpus(spark, corpus_at(spark, tmp_path / name, bad))
    with pytest.raises(ValueError):
        load_corpus(spark, corpus_at(spark, tmp_path / "short", META, held=1))


def test_metadata_fields(column):
    texts = [
        json.dumps(META, indent=2),
        '{"user_id": 7, "end_id" :\t8, "im_start_id": 1, "pad_id": -3, "dtype" : "u32"}',
        "{}",
        '{"vocab_size": "many", "assistant_id":+4}',
    ]
    got = [tuple(r) for r in column(texts, meta_fields(F.col("t")))]
    assert got == [
        ("u16", 9, 0, 1, -1, 2),
        ("u32", -1, -3, 7, -1, 8),
        (None, -1, 0, -1, -1, -1),
        (None, 0, 0, -1, 4, -1),
    ]
    assert column(['{"a":1}'], int_field(F.col("t"), "b", 5)) == [5]
    assert column(['{"a": "x y"}'], string_field(F.col("t"), "a")) == ["x y"]


def test_metadata_document(spark):
    stats = spark.createDataFrame([(3, 1, 65_535), (3, 1, 65_536)], "train_samples int, eval_samples int, vocab_size int")
    docs = [json.loads(r["meta"]) for r in meta_document(stats, F.lit("d")).collect()]
    assert docs[0] == {
        "name": "d", "samples": 4, "train_samples": 3, "eval_samples": 1, "vocab_size": 65_535, "dtype": "u16",
        "special_tokens": {"pad_id": 0, "im_start_id": 1, "im_end_id": 2}, "tokenizer_path": "tokenizer",
    }
    assert docs[1]["dtype"] == "u32"
    extra = meta_document(stats, F.lit("d"), eos_token_id=F.lit(2), tokenizer_name=F.lit("bpe")).first()["meta"]
    assert json.loads(extra)["eos_token_id"] == 2 and json.loads(extra)["tokenizer_name"] == "bpe"
    assert stats.select(storage_type(F.lit(65_536))).first()[0] == "u32"


def test_models_load_only_with_their_own_settings(spark, tmp_path):
    config = {"model_order": 2, "base": 257, "pad": 256, "end": 256, "vocab_size": 40}
    docs = spark.createDataFrame([("abab",)], "text string")
    counts = count_ngrams(docs, "text", [1, 2], BYTES)
    path = str(tmp_path / "model")
    save_model(counts, config, path)
    loaded = load_model(spark, path, {**config, "seed": 42, "weighting": "token"})
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, counts.collect()))
    for field, value in (("vocab_size", 41), ("weighting", "example"), ("model_order", 3), ("end", None)):
        with pytest.raises(ValueError, match=field):
            load_model(spark, path, {**config, field: value})
    with pytest.raises(ValueError):
        save_model(counts, {"colour": 1}, str(tmp_path / "other"))


def test_prepare_and_evaluate_end_to_end(spark, tmp_path):
    """Pairs to token files, a model of the training tokens, and scored replies of that model."""
    pairs = spark.createDataFrame(
        [(i, f"Hello  there {i % 3}", f"the lamp is ON {i % 5}") for i in range(60)],
        "pair_id int, input string, output string",
    )
    directory = str(tmp_path / "corpus")
    tokenizer = prepare(framed(pairs), "pair_id", directory, "toy", 300)
    tokens, meta = load_corpus(spark, f"{directory}/train.bin")
    assert meta["vocab_size"] == tokenizer.vocab_size and meta["end_id"] == 2
    assert Tokenizer.load(spark, f"{directory}/tokenizer") == tokenizer
    text = json.loads(spark.read.text(f"{directory}/meta.json").first()[0])
    assert (text["train_samples"], text["eval_samples"]) == (57, 3)
    words = tokenizer.decode(tokens.orderBy("first_idx"), skip_special=False).collect()
    joined = "".join(r["text"] for r in words)
    assert joined.count("<|im_start|>user\nhello there") == 60
    train = tokens.where("split = 'train'")
    counts = count_ngrams(train, "tokens", [1, 2, 3], token_alphabet(tokenizer))
    scored = evaluate(case_table(spark), tokenizer, counts, 3, max_new=12).collect()
    assert len(scored) == 16
    assert any("lamp" in r["reply"] for r in scored)
    assert all("<|" not in r["reply"] for r in scored)


def test_prepare_with_end_tokens_keeps_samples_and_has_no_gap(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f"hi {i}", "yes") for i in range(40)], "pair_id int, input string, output string")
    directory = str(tmp_path / "corpus")
    samples = framed(pairs)
    tokenizer = prepare(samples, "pair_id", directory, "toy", 280, eos=0)
    kept = read_samples(spark, f"{directory}/samples", form="parquet")
    assert kept.columns == ["pair_id", "split", "sample"]
    assert {r["sample"] for r in kept.collect()} == {r["sample"] for r in samples.collect()}
    tokens = explode_tokens(load_corpus(spark, f"{directory}/train.bin")[0].where("split = 'train'"))
    rows = tokens.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(len(rows)))
    assert sum(r["token"] == 0 for r in rows) == kept.where("split = 'train'").count() and rows[-1]["token"] == 0
    assert tokenizer.vocab_size > 259


def test_logs_are_appended(spark, tmp_path):
    log = spark.createDataFrame([(1, 2.5, None, 1e-3), (2, 2.0, float("nan"), 5e-4)], EVALUATIONS)
    path = str(tmp_path / "eval.csv")
    write_log(log.where("step = 1"), path)
    write_log(log.where("step = 2"), path)
    rows = read_log(spark, path, EVALUATIONS).orderBy("step").collect()
    assert [(r["step"], r["train_loss"], r["lr"]) for r in rows] == [(1, 2.5, 1e-3), (2, 2.0, 5e-4)]
    assert rows[0]["val_loss"] is None and rows[1]["val_loss"] != rows[1]["val_loss"]


def test_a_path_tells_its_kind(spark, tmp_path):
    kind, tokens = read_corpus(spark, corpus_at(spark, tmp_path / "tokens", META))
    assert kind == "tokens" and tokens.columns == ["split", "first_idx", "tokens"]
    (tmp_path / "lines.txt").write_text("one\n\ntwo\n")
    (tmp_path / "empty.txt").write_text("\n\n")
    got = {name: read_corpus(spark, str(tmp_path / name)) for name in ("lines.txt", "empty.txt", "absent.txt")}
    assert {kind for kind, _ in got.values()} == {"lines"}
    assert sorted(r["line"] for r in got["lines.txt"][1].collect()) == ["one", "two"]
    for name in ("empty.txt", "absent.txt"):
        assert sorted(r["line"] for r in got[name][1].collect()) == FALLBACK_LINES


def test_a_second_write_is_refused_and_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t.bin")
    first = spark.createDataFrame([(0, [1, 2, 3])], "first_idx bigint, tokens array<int>")
    write_tokens(first, path)
    with pytest.raises(FileExistsError):
        write_tokens(spark.createDataFrame([(3, [4, 5])], "first_idx bigint, tokens array<int>"), path)
    assert [r["token"] for r in explode_tokens(read_tokens(spark, path)).orderBy("idx").collect()] == [1, 2, 3]


def test_a_corpus_by_glob_is_read_and_only_an_absent_one_falls_back(spark, tmp_path):
    from lexiloom.sources.corpus import read_corpus

    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    kind, lines = read_corpus(spark, str(tmp_path / "*.txt"))
    assert kind == "lines" and sorted(r["line"] for r in lines.collect()) == ["one", "two"]
    assert "anna" in {r["line"] for r in read_corpus(spark, str(tmp_path / "absent" / "*.txt"))[1].collect()}


def test_windows_are_read_by_seeking(spark, tmp_path):
    """Windows of one and of several parts, at both ends; only their own bytes are read."""
    path = f"{tmp_path}/tokens"
    stream = spark.range(40).select((F.col("id") * 25).alias("first_idx"), F.transform(F.sequence(F.col("id") * 25, F.col("id") * 25 + 24), lambda x: x.cast("int")).alias("tokens"))
    write_tokens(stream, path, tokens_per_part=100)
    draws = spark.createDataFrame([(1, 0, 9), (2, 95, 9), (3, 990, 9), (4, 50, 400), (5, 998, 9)], "draw int, start_idx bigint, n bigint")
    got = {r["draw"]: r["tokens"] for r in token_windows(draws, "draw", path).collect()}
    assert got == {1: list(range(10)), 2: list(range(95, 105)), 3: list(range(990, 1000)), 4: list(range(50, 451)), 5: [998, 999]}
    seeker = token_files._Seeker(path, "u16")
    assert list(seeker.range(95, 105)) == list(range(95, 105)) and seeker.bytes_read == 2 * 10
    seeker.close()
    assert token_windows(draws.limit(0), "draw", path).collect() == []
