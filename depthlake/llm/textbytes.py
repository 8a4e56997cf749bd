"""Whole-batch text work on Arrow buffers: words, word hashes and shingles as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``.  Its separators are ASCII, so words are found on the UTF-8
bytes of a whole slice of documents at once, without one Python call per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII letters and bytes of multi-byte characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.base)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse)]))
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(BASE), _Powers(GRAM_BASE)


@dataclass
class Slice:
    """Neighbouring rows of a batch: their bytes, and where each row starts in them."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes (a longer row stands alone); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
        lo = hi


def word_bounds(part: Slice, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of a slice, in order; no word crosses rows."""
    inside = ~separators[part.buf]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = part.offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(part.offsets, start, "right") - 1
    return start, end, row


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, equal for equal bytes (after A-Z became a-z if ``lower``)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _BYTES.get(len(buf))
    codes = BYTE_CODES[LOWER] if lower else BYTE_CODES
    with np.errstate(over="ignore"):
        total = np.cumsum(codes[buf] * up)
        first = np.where(start > 0, total[start - 1], np.uint64(0))
        return mix((total[end - 1] - first) * down[start])


def gram_hashes(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``k`` words within one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _GRAMS.get(len(words))
    with np.errstate(over="ignore"):
        total = np.cumsum(words * up)
        before = np.concatenate([[np.uint64(0)], total[:n - 1]])
        value = mix((total[k - 1:k - 1 + n] - before) * down[:n])
    whole = np.flatnonzero(row[:n] == row[k - 1:])
    return value[whole], whole


def latin_lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes; every length stays."""
    low = LOWER[buf]
    if len(buf) > 1:
        second = buf[1:]
        low[1:][(buf[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return low

