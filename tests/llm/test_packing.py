from __future__ import annotations

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lexiloom.llm.packing import TextEncoder, lengths_of, pack  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", "Hello world", "  two  spaces\n\n\tand tabs ", "it's they'll 'quoted'", "über Straße naïve", "数字 ½ ² Ⅷ ٣",
    "<|endoftext|>", "x<|endoftext|>y", "emoji 😀 a​b \x1c\x1f end", "tail   ", "1234 5 6,7.8", "a" * 5000, "\n", " \n x",
    "word " * 2100, "- — … ‘q’", "mixed1a2b_c__d", "\xa0nbsp\xa0\xa0x",
]


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return TextEncoder(file.read())


def library(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(own):
    for text, ids in zip(TEXTS, own.encode(TEXTS)):
        assert ids.tolist() == library(text), text


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000, 4096])
def test_lengths_are_powers_of_two_that_add_up(n):
    parts = lengths_of(n, 1024)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
    assert parts == sorted(parts, reverse=True)
    assert len([p for p in parts if p < 1024]) == len({p for p in parts if p < 1024})


def test_pieces_tile_their_documents_and_fill_their_sequences(docs):
    rows = [*enumerate(TEXTS), (None, None), (2, TEXTS[2])]
    got = pack(docs(rows), PATH).collect()
    tokens = {}
    for r in got:
        assert r.offset == 0 and r.length & (r.length - 1) == 0
        tokens.setdefault(r.doc_id, []).append(r)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_sequence = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_sequence] == sorted(r.length for r in got)
    assert [r.doc_tokens for r in tokens[None]] == [1]
    assert len(tokens[2]) == 2 * len(lengths_of(len(library(TEXTS[2])) + 1, 1024))
    for i, text in enumerate(TEXTS):
        if i == 2:
            continue
        data = np.array(library(text) + [0], "<u4").tobytes()
        at = 0
        for r in sorted(tokens[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(data) // 4
            assert r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(data) // 4


def test_empty_table_and_faulty_arguments(docs):
    assert pack(docs([]), PATH).collect() == []
    with pytest.raises(ValueError):
        pack(docs([]), PATH, longest=1000)
