from __future__ import annotations

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from lexiloom.llm import pieces  # noqa: E402
from lexiloom.llm.pieces import PieceEncoder, decode, encode, round_trip  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "  two  spaces", "a\nb\t c", "aaaaaaa aaaaaaaaaaaaa", "日本語テスト 漢字", "emoji 😀 😀😀 x",
    "        indent\n    def f(x):\n        return x+1", "<s> </s> <unk> <0x41>", "é́ combining", "a" * 300, "hello" * 50, "\x00\x01",
    "international internationalization tokenization", "....!!!???", "1234567890 3.14159", " " * 70, "tail   ", "mixedCASE Ünïcode",
]


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def own(data):
    return PieceEncoder(data)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def split(encoder, texts):
    ids, n = encoder.encode(texts)
    ids, out = ids.tolist(), []
    for size in n.tolist():
        out.append(ids[:size])
        ids = ids[size:]
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    letters = "aaeeiinnrrsstthlou  ABC.,-'1éß▁"
    return ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(n)]


def test_ids_equal_the_library(own, library):
    texts = TEXTS + random_texts(1, 400)
    for text, ids in zip(texts, split(own, texts)):
        assert ids == library.encode(text), text


def decoded(encoder, rows):
    flat = np.array([i for ids in rows for i in ids], np.int32)
    return encoder.decode(flat, np.array([len(ids) for ids in rows], np.int64)).to_pylist()


def test_decoding_equals_the_library_and_gives_texts_back(own, library):
    assert decoded(own, split(own, TEXTS)) == TEXTS
    assert decoded(own, []) == [] and decoded(own, [[], []]) == ["", ""]
    rng = random.Random(2)
    rows = [[rng.randrange(3, 32000) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    rows += [[rng.randrange(3, 259) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    got = decoded(own, rows)
    assert got == [decoded(own, [ids])[0] for ids in rows]
    for ids, text in zip(rows[:200], got):
        assert text == library.decode(ids)


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_model(rows):
    """A model file of weighted pieces, without byte pieces."""
    import struct

    out = b""
    for piece, score, kind in rows:
        body = b"\x0a" + varint(len(piece.encode())) + piece.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)
        out += b"\x0a" + varint(len(body)) + body
    trainer, normalizer = b"\x18\x01", b"\x0a\x08identity\x18\x01\x20\x00"
    return out + b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normalizer)) + normalizer


def test_unigram_scores_equal_the_library():
    rng = random.Random(3)
    words = {"".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(120)} | set("abcd▁") | {"▁a", "▁ab", "▁▁"}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(w, round(-rng.uniform(1, 12), 3), 1) for w in sorted(words)]
    model = unigram_model(rows)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = PieceEncoder(model)
    texts = ["".join(rng.choices("abcd  ", k=rng.randint(0, 40))) for _ in range(200)]
    score = encoder.model.scores
    for text, ids in zip(texts, split(encoder, texts)):
        want = library.encode(text)
        assert ids == want or abs(score[ids].sum() - score[want].sum()) < 1e-3, text


def test_small_groups_and_no_memory_give_the_same(own, data, monkeypatch):
    monkeypatch.setattr(pieces, "ROWS", 3)
    monkeypatch.setattr(pieces, "MEMO_WORDS", 0)
    assert split(PieceEncoder(data), TEXTS) == split(own, TEXTS)


def test_rows(docs, library):
    rows = [*enumerate(TEXTS), (None, None), (3, TEXTS[3])]
    got = decode(encode(docs(rows), PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "" if r.doc_id is None else TEXTS[r.doc_id]
        assert list(r.ids) == library.encode(text) and r.decoded == text
    assert sorted(map(str, round_trip(docs(rows), PATH).collect())) == sorted(map(str, got))


def test_empty_table_and_other_models(docs):
    assert decode(encode(docs([]), PATH), PATH).collect() == []
    with pytest.raises(ValueError):
        PieceEncoder(unigram_model([("<unk>", 0.0, 2), ("a▁b", -1.0, 1)]))
