"""Words and shingles of whole texts as 64-bit hashes, for a batch of texts at a time.

A word is a run of ASCII letters and digits and of all characters beyond ASCII, with A-Z folded. The bytes
of UTF-8 beyond ASCII are all 0x80 or more, so words are found in the bytes. The hash of a word is a
polynomial over random values of its bytes, read off one running sum, and then mixed.
"""

from __future__ import annotations

import numpy as np

from opsloom.llm.shared import ranges

SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes per pass; a longer run without a separator is taken whole.
_PASS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = True
    return table


def _byte_values() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    codes[0x41:0x5B] += np.uint64(0x20)
    return mix((codes + np.uint64(1)) * _STEP)


WORD_BYTE = _word_bytes()
_VALUE = _byte_values()
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept for the largest n asked for."""
    if base not in _powers or len(_powers[base]) < n:
        row = np.full(max(n, _PASS + 1), base, np.uint64)
        row[0] = 1
        _powers[base] = np.multiply.accumulate(row)
    return _powers[base][:n]


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words, and for each text its range of words (n + 1 bounds)."""
    inside = WORD_BYTE[raw]
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cuts[1 : len(raw)]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cuts[1 : len(raw)]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PASS, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        n = high - low
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw[low:high]] * _power(_BASE, n), out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = mix((total[e] - total[s]) * _power(_INVERSE, n)[s])
        at = to
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, per_text: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a text, and n + 1 bounds.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    n = np.diff(per_text)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    at = ranges(per_text[:-1], counts)
    limit = np.repeat(per_text[1:], counts)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        part = np.uint64(pow(_BASE, j + 1, 1 << 64))
        if (at + j < limit).all():
            total += hashes[at + j] * part
        else:
            here = at + j < limit
            total[here] += hashes[at[here] + j] * part
    return mix(total), np.concatenate(([0], np.cumsum(counts)))


def weighted(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items of each text with how often they occur: items, counts, n + 1 bounds. Ordered within a text."""
    items = items.copy()
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        items[first:last].sort()
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(items)))
    return items[at], counts, np.searchsorted(text[at], np.arange(len(bounds)))
