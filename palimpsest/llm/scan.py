"""Vectorised scanning of text batches: UTF-8 buffers as code-point arrays, classes, slices and their distinct values.

A batch of texts stays one byte buffer; positions are numpy arrays. Nothing here loops over characters or tokens.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Bytes of text that are scanned at once; bounds the memory of the position arrays.
BLOCK = 1_500_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """uint8 class of every code point: letter (L*), number (N*), white space, other."""
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    for lo, hi in ((0, 0x323B0), (0xE0000, 0xE0200)):  # no letters or numbers are assigned elsewhere
        t[lo:hi] = [{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(lo, hi)]
    t[list(WHITE_SPACE)] = SPACE
    return t


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK):
    """(first row, row count, buffer, byte offsets) for runs of rows of about `limit` bytes; a null is an empty text.
    A text longer than that makes a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Block:
    """A run of texts: `cp` code points, `byte` the byte position of each (and the end), `doc` first code point of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        lead = (data & 0xC0) != 0x80
        self.byte = np.append(np.flatnonzero(lead), len(data)).astype(np.int32)
        self.cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.doc = np.searchsorted(self.byte, offsets).astype(np.int64)

    def text_starts(self) -> np.ndarray:
        """Flags the first code point of each text that isn't empty."""
        at = np.zeros(len(self.cp) + 1, bool)
        at[self.doc] = True
        return at[:-1]


_MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte slice: a polynomial over random byte values, by prefix sums and the inverse power."""
    n = len(data)
    power = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * power[:n], out=total[1:])
    h = (total[end] - total[start]) * _inverse_powers(n + 1)[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)) ^ (end - start).astype(np.uint64)


_cache: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            have = np.multiply.accumulate(p)
        if n <= 2 * BLOCK:
            _cache[name] = have
    return have


def _powers(n: int) -> np.ndarray:
    return _grown("p", int(_MULT), n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("i", pow(int(_MULT), -1, 2**64), n)


def distinct_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a representative of each distinct slice, number of its slice for each slice), exact.

    Slices are grouped by hash; then each is compared with its representative byte by byte, all at once. Should two
    slices ever share a hash, all are grouped by their bytes instead.
    """
    h = slice_hashes(data, start, end)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    length = end - start
    same = length == length[first][inverse]
    if same.all():
        where = ragged(start, length)
        there = ragged(start[first][inverse], length)
        same = (data[where] == data[there]).all()
    else:
        same = False
    if not same:
        raw = data.tobytes()
        seen: dict[bytes, int] = {}
        inverse = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        _, first = np.unique(inverse, return_index=True)
    return first, inverse


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + length)."""
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)
