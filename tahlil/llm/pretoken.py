"""Splitting text into the words of a byte-level BPE tokenizer, on whole Arrow batches.

The tokenizer's own rule cuts a text into contractions, letter runs, number runs and runs of other
characters, each with at most one leading blank, and runs of white space. The rule is evaluated here with
array operations over the code points of all texts of a batch at once, so no Python code runs per word.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The characters with Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = LETTER
        elif c == "N":
            out[cp] = NUMBER
    out[WHITE] = SPACE
    return out


def cuts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a word starts, for the code points `cp` of texts that start where `first` is true."""
    n = len(cp)
    k = classes()[cp]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(k[1:], k[:-1], out=change[1:])
    space = k == SPACE
    change |= first
    start = change.copy()
    blank = cp == 0x20
    # a blank joins the run that follows it
    start[1:] &= ~(blank[:-1] & ~space[1:] & ~first[1:])
    # the last white space of a run before a word stands alone or joins that word
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last
    # contractions: a lone apostrophe, not after a blank, before certain letters
    a = np.flatnonzero((cp == 0x27) & start)
    if len(a):
        pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
        stop = np.concatenate([first, np.ones(3, bool)])
        one = ~stop[a + 1] & np.isin(pad[a + 1], [ord(c) for c in "stmd"])
        two = ~stop[a + 1] & ~stop[a + 2] & np.isin(pad[a + 1].astype(np.int64) * 0x110000 + pad[a + 2], [ord(x[0]) * 0x110000 + ord(x[1]) for x in ("re", "ve", "ll")])
        for at, length in ((a[one], 2), (a[two], 3)):
            start[at + 1] = False
            ends = at + length
            ends = ends[ends < n]
            start[ends] |= k[ends] == LETTER
    return start


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the place in them at which each text starts (with the end).

    Null and empty texts have no words.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    if begin == end:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    raw = texts.buffers()[2].slice(begin, end - begin)
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    cp = np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    rel = offsets - begin
    first = np.zeros(len(cp), bool)
    filled = rel[:-1] < rel[1:]
    first[np.searchsorted(at, rel[:-1][filled])] = True
    starts = at[cuts(cp, first)]
    bounds = np.append(starts, end - begin).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), raw)
    return out, np.searchsorted(starts, rel)
