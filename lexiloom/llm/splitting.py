"""Distinct pre-tokens of a batch of texts, found with numpy over code points.

The split follows the public pattern of byte-level vocabularies: a run of letters, of digits or of other
signs, each with one leading space; a run of white space without its last character; else single white
space. ``split`` handles texts whose characters are all in ``SIMPLE`` (ASCII without apostrophes, Latin
letters, general punctuation); the caller encodes the other texts with the tokenizer's library.
"""

from __future__ import annotations

import re
import sys

import numpy as np

from lexiloom.shipping import ship

ship(__name__)

#: Characters whose class is the same in every Unicode version and every pattern engine.
SIMPLE = re.compile("[\t-\r -&(-~¡-±´-¸º»¿-ɏ‐-‧]*+")
BASE = np.uint64(0x9E3779B97F4A7C15)
SECTION = 1 << 20


def char_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 other, by code point."""
    chars = [chr(i) for i in range(0x2028)]
    return np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 for c in chars], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``codes`` (starts ascending), from prefix sums over sections."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        powers = backs = np.ones(0, np.uint64)
        while low < len(starts):
            first = int(starts[low])
            high = max(low + 1, int(np.searchsorted(starts, first + SECTION)))
            last = int(ends[high - 1])
            if len(powers) <= last - first:
                powers = np.full(last - first + 1, BASE, np.uint64)
                backs = np.full(last - first + 1, inverse, np.uint64)
                powers[0] = backs[0] = 1
                powers, backs = np.multiply.accumulate(powers), np.multiply.accumulate(backs)
            sums = np.zeros(last - first + 1, np.uint64)
            piece = mix(codes[first:last].astype(np.uint64) + np.uint64(1))
            np.cumsum(piece * powers[: last - first], out=sums[1:])
            s, e = starts[low:high] - first, ends[low:high] - first
            out[low:high] = mix((sums[e] - sums[s]) * backs[s] + (e - s).astype(np.uint64))
            low = high
    return out


def split(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, and start, end and text number of every pre-token."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode(f"utf-32-{sys.byteorder[0]}e"), np.uint32)
    n = len(codes)
    if not n:
        none = np.empty(0, np.int64)
        return codes, none, none, none
    kind = classes[codes]
    space = kind == 0
    opens = np.zeros(n + 1, bool)
    opens[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    opens[n] = True
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    plain = codes == 32
    after_plain = np.zeros(n, bool)
    after_plain[1:] = plain[:-1]
    # the last of a run of white space starts a token if a sign of the same text follows
    closes_run = np.zeros(n, bool)
    closes_run[:-1] = ~space[1:]
    closes_run &= ~opens[1:]
    begins = np.where(space, ~after_space | closes_run, changed & ~after_plain) | opens[:-1]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    owner = np.repeat(np.arange(len(texts)), lengths)[starts]
    return codes, starts, ends, owner
