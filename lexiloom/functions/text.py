"""Whitespace, case and byte-level text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# The characters that count as whitespace when text is split or stripped,
# and those that end a line of program output.
WHITESPACE_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE_CHARS = "".join(map(chr, WHITESPACE_CODES))
WHITESPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\n-\r\x1c-\x1e\x85\x{2028}\x{2029}"

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def collapse(text: Column) -> Column:
    """Every run of whitespace becomes one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def normalize(text: Column) -> Column:
    return F.lower(collapse(text))


def sanitize_ascii(text: Column) -> Column:
    """Line breaks and tabs become spaces, A-Z become a-z, nothing else changes."""
    return F.translate(text, "\n\r\t" + UPPER_ASCII, "   " + UPPER_ASCII.lower())


def sanitize_unicode(text: Column) -> Column:
    """Line breaks and tabs become spaces, every letter is lowered, the ends are stripped."""
    return strip(F.lower(F.translate(text, "\n\r\t", "   ")))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_head(text: Column, size: int) -> Column:
    """The first ``size`` bytes as BINARY; a character may be cut."""
    return F.substring(utf8(text), 1, size)


def byte_tail(text: Column, size: int) -> Column:
    """The last ``size`` bytes as BINARY; a character may be cut."""
    data = utf8(text)
    return F.when(F.octet_length(text) <= size, data).otherwise(F.substring(data, -size, size))


def byte_ids(data: Column) -> Column:
    """BINARY to ARRAY<INT> of byte values, whole Arrow batches at once."""

    def values(batch: pa.Array) -> pa.Array:
        column = batch.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        ids = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        bounds = pa.array((offsets - offsets[0]).astype(np.int32))
        missing = column.is_null() if column.null_count else None
        return pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)), mask=missing)

    return F.arrow_udf(values, ArrayType(IntegerType()))(data)


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(text, WHITESPACE + "+"), lambda w: w != ""))
