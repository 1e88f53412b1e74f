"""Vectorised word and word n-gram hashing over the buffers of an Arrow string column.

Texts are hashed in slices of whole documents, so nothing is looped over per word in Python.
Words are what lies between white space, of Unicode's kinds too; in scripts that are written without spaces (Chinese,
Japanese, Thai, Lao, Khmer, Burmese) each character is a word. A word n-gram that would cross a document's end is
not formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values in place so that every input bit reaches every output bit."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(_INVERSE, k, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about most_bytes; a longer document is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _beyond_ascii(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the bytes of white space, places where a character of an unspaced script begins or has ended) among
    the characters of several bytes in UTF-8 texts."""
    lead = np.flatnonzero(part >= 0xC2)
    none = np.zeros(0, np.int64)
    if not len(lead):
        return none, none
    padded = np.concatenate([part, np.zeros(2, np.uint8)])
    a, b, c = part[lead], padded[lead + 1], padded[lead + 2]
    two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
    wide = (a == 0xE3) & (b == 0x80) & (c == 0x80)
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three = lead[wide | general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))]
    space = np.concatenate([two, two + 1, three, three + 1, three + 2])
    south = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F)))
    own = ((a >= 0xE3) & (a <= 0xE9) & ~wide) | south
    rare = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    return space, np.concatenate([lead[own], lead[own] + 3, lead[rare], lead[rare] + 4])


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each document) for documents lying side by side."""
    n_docs = len(offsets) - 1
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, U64), np.zeros(n_docs, np.int64)
    part = data[lo:hi]
    space, unspaced = _beyond_ascii(part)
    inside = np.zeros(hi - lo + 2, np.int8)
    inside[1:-1] = part > 32
    inside[space + 1] = 0
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    # a word is also cut where a document ends, and around characters that are words
    cuts = np.concatenate([offsets[1:-1] - lo, unspaced])
    cuts = np.unique(cuts[(cuts > 0) & (cuts < hi - lo)])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)] if len(cuts) else cuts
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    up, down = _POWERS.get(hi - lo + 1)
    sums = np.zeros(hi - lo + 1, U64)
    np.cumsum((part.astype(U64) + U64(1)) * up[: hi - lo], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    bounds = np.searchsorted(starts, offsets - lo)
    return mix64(hashes), np.diff(bounds)


def grams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word n-gram, number of them in each document). A document of fewer than n
    words, but at least one, has one gram made of all its words."""
    total = len(hashes)
    if not total:
        return np.zeros(0, U64), np.zeros(len(counts), np.int64)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    end = first + counts
    left = end[doc] - np.arange(total)  # words from here to the document's end
    out = np.zeros(total, U64)
    factor = 1
    for j in range(n):
        factor = factor * _GRAM % (1 << 64)
        if j == 0:
            out += hashes * U64(factor)
        else:
            out[: total - j] += np.where(left[: total - j] > j, hashes[j:] * U64(factor), U64(0))
    keep = left >= n
    short = first[(counts > 0) & (counts < n)]
    keep[short] = True
    return mix64(out[keep]), np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
