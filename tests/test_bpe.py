from __future__ import annotations

from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from lexiloom.operators import bpe
from lexiloom.sources.metadata import SPECIAL_TOKENS

TEXTS = [
    "the cat sat on the mat, the bat sat on the cat",
    "aaaaaaa aaa aaaa  aa",
    "don't 1234  123 éé çà  \n\n x\t y",
    "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello hello<|im_end|>",
    "",
    "abababab ababab abcabc",
]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def merged(ids, left, right, new):
    out, i = [], 0
    while i < len(ids):
        if ids[i : i + 2] == [left, right]:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def one_at_a_time(texts, vocab_size):
    """Learning by definition: recount all pairs before every single merge."""
    vocab = [t.encode() for t in SPECIAL_TOKENS] + [bytes([b]) for b in bpe.byte_order()]
    known = {b: i for i, b in enumerate(vocab)}
    words = Counter(w for t in texts for w in regex.findall(PATTERN, t))
    table = [([known[bytes([b])] for b in w.encode()], n) for w, n in words.items()]
    merges = []
    while len(vocab) < vocab_size:
        pairs = Counter()
        for ids, n in table:
            for pair in zip(ids, ids[1:]):
                pairs[pair] += n
        frequent = [(-n, pair) for pair, n in pairs.items() if n >= 2]
        if not frequent:
            break
        n, (left, right) = min(frequent)
        spelled = vocab[left] + vocab[right]
        if spelled not in known:
            known[spelled] = len(vocab)
            vocab.append(spelled)
        merges.append((left, right, known[spelled], -n))
        table = [(merged(ids, left, right, known[spelled]), n) for ids, n in table]
    return merges, vocab


def test_batched_learning_equals_one_at_a_time(spark):
    merges, vocab = one_at_a_time(TEXTS, 320)
    learned = bpe.learn(docs_of(spark, TEXTS), "text", 320)
    assert learned.merges == merges
    assert learned.vocab == vocab
    assert learned.vocab_size < 320  # no pair is left that occurs twice


@pytest.mark.parametrize("text", ["ab ab ba ba aa bb abab baba", "aaa aaaa aaaaa aab aab baa", "xyxyx yxyxy xx yy xyx"])
def test_overlapping_pairs(spark, text):
    merges, vocab = one_at_a_time([text] * 3, 290)
    learned = bpe.learn(docs_of(spark, [text] * 3), "text", 290)
    assert (learned.merges, learned.vocab) == (merges, vocab)


def test_vocabulary_and_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer(tokenizers.models.BPE())
    library.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.decoder = tokenizers.decoders.ByteLevel()
    trainer = tokenizers.trainers.BpeTrainer(
        vocab_size=300,
        special_tokens=SPECIAL_TOKENS,
        min_frequency=2,
        initial_alphabet=tokenizers.pre_tokenizers.ByteLevel.alphabet(),
        show_progress=False,
    )
    library.train_from_iterator(TEXTS, trainer)
    learned = bpe.learn(docs_of(spark, TEXTS), "text", 300)
    assert learned.vocab_size == library.get_vocab_size()
    probes = [*TEXTS, "a<pad>b !!<|im_end|>  ", "   ", "<pad><pad>", "cat's ñ 日本 \U0001f600"]
    encoded = learned.encode(docs_of(spark, probes)).orderBy("doc_id")
    assert [r["tokens"] for r in encoded.collect()] == [library.encode(t).ids for t in probes]
    decoded = learned.decode(encoded.withColumnRenamed("text", "was")).orderBy("doc_id").collect()
    assert [r["text"] for r in decoded] == [library.decode(library.encode(t).ids) for t in probes]


def test_pretokens_lose_nothing(spark):
    docs = docs_of(spark, TEXTS)
    joined = docs.select("text", F.array_join(bpe.pretokens(F.col("text")), "").alias("j"))
    assert joined.where("j <> text").count() == 0
    for r in docs.select("text", bpe.pretokens(F.col("text")).alias("p")).collect():
        assert r["p"] == regex.findall(PATTERN, r["text"])


def test_special_tokens_come_first_and_are_atomic(spark):
    learned = bpe.learn(docs_of(spark, TEXTS), "text", 280)
    table = learned.vocab_table(spark).where("special").orderBy("token_id").collect()
    assert [bytes(r["bytes"]).decode() for r in table] == SPECIAL_TOKENS
    ids = learned.encode(docs_of(spark, ["x<|im_end|>"])).first()["tokens"]
    assert ids[-1] == 2
    kept = learned.decode(learned.encode(docs_of(spark, ["x<|im_end|>y"])).drop("text"), skip_special=False)
    assert kept.first()["text"] == "x<|im_end|>y"


def test_no_pair_is_frequent_enough(spark):
    assert bpe.learn(docs_of(spark, ["ab cd"]), "text", 1000).merges == []
    with pytest.raises(ValueError):
        bpe.learn(docs_of(spark, ["ab"]), "text", 2)


def test_saved_tokenizers_load(spark, tmp_path):
    learned = bpe.learn(docs_of(spark, TEXTS), "text", 290)
    learned.save(spark, str(tmp_path / "t"))
    assert bpe.Tokenizer.load(spark, str(tmp_path / "t")) == learned


def test_very_long_word(spark):
    learned = bpe.learn(docs_of(spark, TEXTS), "text", 290)
    text = "ab" * 50_000
    encoded = learned.encode(docs_of(spark, [text])).drop("text")
    assert learned.decode(encoded).first()["text"] == text


def test_broken_utf8_becomes_replacement_characters(spark):
    learned = bpe.learn(docs_of(spark, ["é"]), "text", 259)
    half = learned.encode(docs_of(spark, ["é"])).select(F.slice("tokens", 1, 1).alias("tokens"))
    assert learned.decode(half).first()["text"] == "�"


def test_long_words_are_segmented_like_short_ones():
    import random

    rng = random.Random(4)
    ranks = {}
    symbols = list("abcd")
    for rank in range(40):
        pair = rng.choice(symbols) + rng.choice(symbols)
        if pair not in ranks:
            merged = chr(0x4000 + rank)
            ranks[pair] = (rank, merged)
            symbols.append(merged)
    for n in (2, 5, 40, 64, 65, 300):
        for _ in range(20):
            word = "".join(rng.choices("abcd", k=n))
            slow = word
            while True:
                fits = [ranks[a + b] + (a + b,) for a, b in zip(slow, slow[1:]) if a + b in ranks]
                if not fits:
                    break
                slow = slow.replace(min(fits)[2], min(fits)[1])
            assert bpe.segment_long(word, ranks) == slow == bpe.segment(word, ranks)
    assert len(bpe.segment("".join(rng.choices("abcd", k=1_000_000)), ranks)) < 1_000_000


def test_batches_are_spelled_in_steps(monkeypatch):
    """A batch of many words is encoded a few words at a time, to the same ids, and the memo stays small."""
    import pyarrow as pa

    from lexiloom.operators import bpe

    found = []
    monkeypatch.setattr(bpe.F, "arrow_udf", lambda kind: lambda f: found.append(f) or f)
    ranks = {bpe.symbol(260) + bpe.symbol(261): (0, bpe.symbol(400))}
    rows = [["ab", " c"], [], ["x" * 100, "ab", "<|im_end|>", "é"], ["ab"], []] * 5
    words = pa.array(rows, pa.list_(pa.string())).slice(1)
    bpe._encoder(ranks)
    whole = found[0](words).to_pylist()
    assert bpe.MEMO_WORDS <= 1 << 17
    monkeypatch.setattr(bpe, "WORDS_PER_STEP", 3)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 2)
    bpe._encoder(ranks)
    assert found[1](words).to_pylist() == whole
    assert [len(w) > 0 for w in whole] == [len(r) > 0 for r in rows[1:]]
    assert found[1](words.slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize("dense", [1 << 22, 1])
def test_blocks_of_words_merge_as_words_do(spark, monkeypatch, dense):
    """A round reads blocks of many words each, and counts and merges in them as in single words."""
    monkeypatch.setattr(bpe, "DENSE_PAIRS", dense)
    texts = [*TEXTS, "", "x", "aaa aaaa aaaaa", "\u00e9\u00e9\u00e9 \u65e5\u672c\u65e5\u672c"]
    words = bpe.pretoken_counts(docs_of(spark, texts))
    blocks = bpe.word_blocks(words.coalesce(1))
    assert blocks.count() == 1
    held = [(w, n) for w, n in words.collect() if len(w.encode()) > 1]
    vocab = [t.encode() for t in SPECIAL_TOKENS] + [bytes([b]) for b in bpe.byte_order()]
    table = [([vocab.index(bytes([b])) for b in w.encode()], n) for w, n in held]
    for left, right, new in (("a", "t", 259), ("a", "a", 260), ("h", "e", 261)):
        pairs = Counter()
        for ids, n in table:
            for pair in zip(ids, ids[1:]):
                pairs[pair] += n
        assert {(r["left"], r["right"]): r["n"] for r in bpe.block_pairs(blocks, new).collect()} == pairs
        merge = (vocab.index(left.encode()), vocab.index(right.encode()), new, 0)
        blocks = bpe.merge_blocks(blocks, [merge])
        table = [(ids, n) for ids, n in ((merged(ids, *merge[:3]), n) for ids, n in table) if len(ids) > 1]
