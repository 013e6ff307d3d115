"""Hashes of word shingles of whole texts, in array operations."""

from __future__ import annotations

import numpy as np

SIZE = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.Generator(np.random.Philox(key=[7, 1])).integers(0, 1 << 63, 256, np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_KEPT = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64; long ones are not kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, 1 << 16)
    made = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (_ODD, _INVERSE)]
    if size <= _KEPT:
        _powers = made
    return made


def word_hashes(text: str, places: bool = False):
    """A 64-bit hash for each word (run without ASCII white space) of a text in lower case; with
    ``places`` also the bytes where they start."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        none = np.zeros(0, np.uint64)
        return (none, none) if places else none
    word = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    forward, back = _power(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * forward[: len(data)])])
    made = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return (made, starts) if places else made


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size`` words in a row; a shorter text is one shingle,
    a text without a word has none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        h = mix(h * np.uint64(31) + words[k : k + n])
    return np.unique(h)
