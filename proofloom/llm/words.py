"""Vectorised word and shingle hashing of UTF-8 text inside tasks."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes that are hashed together.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, dtype=_U)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z alone."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_separators() -> np.ndarray:
    """True for the bytes 0x20 and 0x09-0x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def word_spans(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and for each row of `at` (offsets from 0) the index of its first word; at[-1] closes."""
    inside = ~separator[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = at[1:-1]
        before[cuts[cuts < len(data)]] = False  # a row's first byte always starts anew
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        cuts = at[1:-1] - 1
        after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand. Spans are in order; they are worked on in blocks, so memory does not follow the longest text."""
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        first, last = int(starts[i]), int(ends[j - 1])
        up, down = _power(last - first + 1)
        total = np.zeros(last - first + 1, dtype=_U)
        np.cumsum(_BYTE[data[first:last]] * up[: last - first], out=total[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(_U))
        i = j
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words within rows, and the row of each; a shorter row with words is one run of all its words."""
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    factors = [mix(np.asarray([i + 1], _U) * _U(0xA0761D6478BD642F))[0] | _U(1) for i in range(size)]
    n = max(0, len(words) - size + 1)
    value = np.zeros(n, dtype=_U)
    for i, f in enumerate(factors):
        value += words[i : i + n] * f
    whole = rows[:n] == rows[size - 1 : size - 1 + n] if n else np.zeros(0, bool)
    value, owner = mix(value[whole] + _U(size)), rows[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=_U)
        for i in range(size - 1):
            has = counts[short] > i
            extra[has] += words[first[short[has]] + i] * factors[i]
        value = np.concatenate([value, mix(extra + counts[short].astype(_U))])
        owner = np.concatenate([owner, short])
    return value, owner


def distinct_by_row(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and row offsets into them."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(rows + 1))
