"""Anchors of fixed-length byte strings: minimizers, by array operations.

Every string of ``length`` bytes is assigned the least of the hashes of its ``GRAM``-byte pieces (the
first of equal ones), its anchor. Equal strings have equal anchors at equal places, so strings only have to be
compared with those of the same anchor. Consecutive strings of one anchor form a run, a longer
piece of text that stands for all of them.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
_U = np.uint64
_MULT = 0xA0761D6478BD642F
_tables: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18), base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 1 << 22:
            _tables[name] = have
    return have


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xE7037ED1A0B428DB)
    h ^= h >> _U(29)
    h *= _U(0x8EBC6AF09C88C6E3)
    return h ^ (h >> _U(32))


class Text:
    """Hashes of any pieces of one text by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.n = n
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * _power("up", _MULT, n + 1)[:n], out=self.total[1:])
        self.down = _power("down", pow(_MULT, -1, 1 << 64), n + 1)

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        return _mix((self.total[size:] - self.total[:-size]) * self.down[: self.n - size + 1])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values (doubling: two overlapping powers of two)."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(text: Text, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first string, last string) of the runs of all strings of ``length`` bytes."""
    if text.n < length:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    h = text.grams(GRAM)
    width = length - GRAM + 1
    low = sliding_min(h, width)
    # the anchor of string i is the first place from i on with the value low[i]
    candidate = np.flatnonzero(_is_low(h, low, width))
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    # equal neighbours in low may still move from one place to the next equal one
    if len(candidate) and len(np.unique(h[candidate])) < len(candidate):
        place = _first_place(h, low, candidate)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at = place[first]
    else:
        order = np.argsort(h[candidate])
        at = candidate[order][np.searchsorted(h[candidate], low[first], sorter=order)]
    last = np.concatenate([first[1:], [len(low)]]) - 1
    return h[at], at, first, last


def _is_low(h: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some string's."""
    n = len(h)
    out = np.zeros(n, bool)
    top = np.full(n + width - 1, 0, np.uint64)
    top[width - 1 : width - 1 + len(low)] = low  # string i covers places i .. i + width - 1
    # place p is covered by strings p - width + 1 .. p; it is an anchor's value if the largest of their minima is its value
    out[:] = _sliding_max(top, width)[:n] == h
    return out


def _sliding_max(h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        h = np.maximum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.maximum(h[: len(h) - rest], h[rest:]) if rest else h


def _first_place(h: np.ndarray, low: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """For each string i the first candidate place from i on with value low[i]."""
    order = np.lexsort((candidate, h[candidate]))
    values, places = h[candidate][order], candidate[order]
    names, value_of = np.unique(values, return_inverse=True)
    n = len(h) + 1
    keys = value_of.astype(np.int64) * n + places  # ascending
    want = np.searchsorted(names, low).astype(np.int64) * n + np.arange(len(low))
    return places[np.searchsorted(keys, want)]
