"""Words of a batch of texts: runs of bytes other than white space, found and hashed with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexiloom.llm.common import text_bytes
from lexiloom.shipping import ship

ship(__name__)

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and start, end and row of every word."""
    values, offsets = text_bytes(column)
    n = len(values)
    inside = ~WHITE[values]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return values, starts, ends, owner
