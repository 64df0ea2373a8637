"""Packing by power-of-two decomposition.

The tokens of a document, with an end token, are cut into pieces whose lengths are powers of two: as many of
the longest length as fit, then the binary digits of the rest, longest first. Each piece is a sequence of its
own, and sequences are numbered bucket by bucket of equal lengths, so batches of one length need no padding
and no sequence crosses documents.

Defined results: a null text is empty and still has its end token; null ids are ids like any other; equal
rows give pieces of their own each; an empty table gives an empty one.
"""

from __future__ import annotations

import array
import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import numbered, slices
from lexiloom.llm.splitting import SIMPLE, char_classes, span_hashes, split
from lexiloom.shipping import ship

ship(__name__)

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Text bytes whose distinct pre-tokens are looked for together.
BATCH_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    """Token ids of whole texts, as the vocabulary file's own library gives them.

    Texts of simple characters are split with numpy, and each distinct pre-token is encoded once. The rank
    encoder does that when the file's merges are in the order of their ids; the file's library encodes
    texts of other characters and those with special tokens.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        model = json.loads(vocabulary)["model"]
        alphabet = byte_alphabet()
        self.special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = model["vocab"]
        ranks = {
            bytes(alphabet[c] for c in piece): i for piece, i in ids.items() if piece not in self.special
        }
        if [ids[m] for m in merged] != sorted(ids[m] for m in merged):
            raise ValueError("the merges of this vocabulary are not in the order of their ids")
        self.ranked = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.classes = char_classes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        simple = [i for i, t in enumerate(texts) if SIMPLE.fullmatch(t) and not any(s in t for s in self.special)]
        chosen = set(simple)
        for i, text in enumerate(texts):
            if i not in chosen:
                ids = self.whole.encode(text, add_special_tokens=False).ids
                out[i] = np.array(ids, np.uint32)
        codes, starts, ends, owner = split([texts[i] for i in simple], self.classes)
        _, first, number = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        raw = codes.tobytes()
        name = f"utf-32-{sys.byteorder[0]}e"
        begin, end = (starts[first] * 4).tolist(), (ends[first] * 4).tolist()
        encode = self.ranked.encode_ordinary
        found = [encode(raw[b:e].decode(name)) for b, e in zip(begin, end)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.frombuffer(array.array("I", [i for ids in found for i in ids]), np.uint32)
        bases = np.cumsum(sizes) - sizes
        lengths = sizes[number]
        upto = np.cumsum(lengths)
        at = np.arange(int(lengths.sum())) + np.repeat(bases[number] - (upto - lengths), lengths)
        tokens = flat[at]
        counts = np.bincount(owner, lengths, len(simple)).astype(np.int64)
        cuts = np.cumsum(counts) - counts
        for i, low, n in zip(simple, cuts.tolist(), counts.tolist()):
            out[i] = tokens[low : low + n]
        return out


def lengths_of(n: int, longest: int) -> list[int]:
    """``n`` as pieces of power-of-two lengths up to ``longest``, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def piece_batches(vocabulary, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, "text", BATCH_BYTES):
            encoder = encoder or TextEncoder(vocabulary.value)
            docs = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            for doc, ids in zip(docs, encoder.encode(texts)):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n, start = len(data) // 4, 0
                for length in lengths_of(n, longest):
                    crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                    rows.append((doc, start, length, crc, n))
                    start += length
            names = [part.split()[0] for part in PIECES.split(", ")]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack(
    df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    ``vocabulary_path`` is read by the driver, so executors need no file. Pieces, not texts, are shuffled.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = df.sparkSession.sparkContext.broadcast(file.read())
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = texts.mapInArrow(piece_batches(vocabulary, longest, end_id), PIECES)
    return numbered(pieces, ["length"], "sequence_id").select(
        F.col("doc_id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.lit(0).cast("bigint").alias("offset"),
    )
