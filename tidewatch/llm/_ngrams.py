"""Hashes of word n-grams of whole texts, in numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
REACH = 1 << 21


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse modulo 2**64; kept, and longer when a longer text comes."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            each = np.full(size, np.uint64(base & _MASK))
            each[0] = 1
            _powers[k] = np.cumprod(each)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand.

    Starts and ends ascend. Spans are hashed in groups within ``REACH`` bytes (or one by one, if longer), so memory does not grow
    with the text.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + REACH, "right")))
        part, s, e = data[low : int(ends[to - 1])], starts[at:to] - low, ends[at:to] - low
        power, inverse = _upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * power[: len(part)], out=sums[1:])
        out[at:to] = mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space, tab, LF, VT, FF and CR, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence is one if there are fewer words, but some."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(w) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(w))
    return np.unique(span_hashes(data, starts[: len(w) - n + 1], ends[n - 1 :]))
