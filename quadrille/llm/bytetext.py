"""Vectorised kernels over the UTF-8 bytes of an Arrow string column.

A column is handled in slabs of whole rows, so that the working memory is bounded by
``SLAB_BYTES`` or by the longest single text, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 500_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing: digits, letters a-z and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_rng = np.random.Generator(np.random.PCG64(20_241))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows on end, and the rows' offsets in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slabs(offs: np.ndarray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(n, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


@dataclass
class Words:
    """The words of a slab: byte ranges in ``low`` and the row of each."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def text(self, first: int, count: int) -> bytes:
        low = self.low
        return b" ".join(low[s:e].tobytes() for s, e in zip(self.start[first : first + count], self.end[first : first + count]))

    def hashes(self) -> np.ndarray:
        """64-bit hashes that depend on a word's bytes only."""
        n = len(self.low)
        power = powers(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.low] * power[:n], out=prefix[1:])
        h = (prefix[self.end] - prefix[self.start]) * power[n - self.start]
        # the factor still depends on the slab's length: take it out by an inverse power
        h *= pow(int(_BASE), -n, 2**64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of rows after lower-casing A-Z."""
    low = LOWER[data[offs[0] : offs[-1]]]
    ok = WORD[low]
    n = len(low)
    at = offs - offs[0]
    begins = np.zeros(n + 1, dtype=bool)
    begins[at] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = ok
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = ok
    start = np.flatnonzero(after & (~before | begins))
    end = np.flatnonzero(before & (~after | begins))
    return Words(low, start, end, np.searchsorted(at, start, side="right") - 1)


def windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words, and whether it lies in one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = h[:n] * _STEP[0]
    for k in range(1, width):
        out += h[k : k + n] * _STEP[k]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB), row[:n] == row[width - 1 :]
