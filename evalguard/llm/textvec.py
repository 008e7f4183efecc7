"""Vectorised words, shingles and their 64-bit hashes over Arrow string columns (numpy only).

A word is a maximal run of ASCII letters, ASCII digits and code points from U+0080 on, lower-cased.
No loop over characters or words runs in Python; texts are handled in slices of about a quarter of a megabyte,
so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
WORD_PATTERN = "[0-9a-z\u0080-\U0010ffff]+"

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_R_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One flat 32-bit-offset string array without nulls (null becomes the empty string)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a flat string array."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``limit`` bytes each; a longer text stands alone."""
    _, offsets = raw(column)
    n, at = len(column), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of a slice: hash, row in the slice, first and last-plus-one byte; ``bounds`` by row."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    data: np.ndarray


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word; words never cross rows."""
    n = len(data)
    is_word = _WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:n]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(rows: pa.Array, lower: bool = True) -> Words:
    if lower:
        rows = pc.utf8_lower(rows)
    data, offsets = raw(rows)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, np.zeros(len(rows) + 1, np.int64), data)
    start, end = spans(data, offsets)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power(_R, "up", n)[:n], out=total[1:])
    h = mix((total[end] - total[start]) * _power(_R_INV, "down", n + 1)[start])
    bounds = np.searchsorted(start, offsets)
    return Words(h, np.repeat(np.arange(len(rows)), np.diff(bounds)), start, end, bounds, data)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of each ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= _R
        out += h[j : j + n]
    return mix(out)


def shingle_sets(rows: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes.

    A text of 1 to ``width``-1 words has one shingle of all its words; a text without words has one
    of its stripped characters; an empty, blank or null text has none.
    """
    for _, part in slices(rows):
        w = words(part)
        every = windows(w.hash, width)
        for i in range(len(part)):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                yield windows(w.hash[a:b], int(b - a)) ^ _U(b - a)
            else:
                left = part[i].as_py().strip()
                yield mix(np.array([hash_text(left)], np.uint64)) if left else np.zeros(0, np.uint64)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())
