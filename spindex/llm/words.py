"""Word hashes of text columns, in numpy.

A word is a maximal run of ASCII letters and digits and characters beyond
ASCII, lower-cased; texts are lower-cased by Spark before they get here.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_STRETCH = 1 << 18  # bytes summed at a time; a longer word stands alone


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; words never reach over rows."""
    is_word = _WORD[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[offsets] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | border[1:-1]
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:] | border[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the ``n + 1`` word offsets of the rows.

    The hash is a polynomial over the word's bytes, read off prefix sums.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, stop = word_bounds(buf, offsets)
    h = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):  # prefix sums over a bounded stretch of whole words
        b = max(a + 1, int(np.searchsorted(stop, start[a] + _STRETCH, "right")))
        low, high = start[a], stop[b - 1]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((buf[low:high].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, high - low), out=total[1:])
        s, e = start[a:b] - low, stop[a:b] - low
        h[a:b] = mix((total[e] - total[s]) * _powers(_INVERSE, high - low)[s] + (e - s).astype(np.uint64))
        a = b
    return h, np.searchsorted(start, offsets, "left")


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, sorted and distinct; a shorter text is one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mix(h + words[i:i + n])
    return np.unique(h)
