"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_STEP = np.uint64(BASE)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, dtype=np.uint64))])


_POWERS, _INVERSES = _powers(BASE, 1 << 12), _powers(INVERSE, 1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(data: bytes) -> Iterator[bytes]:
    """Pieces of about a megabyte, cut at white space."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + CHUNK)
        while stop < len(data) and not _BLANK[data[stop]]:
            stop += 1
        yield data[start:stop]
        start = stop


def _chunk_words(data: bytes) -> np.ndarray:
    """Polynomial hash of each word: differences of one running sum over the bytes."""
    global _POWERS, _INVERSES
    values = np.frombuffer(data, dtype=np.uint8)
    if len(values) >= len(_POWERS):
        _POWERS, _INVERSES = _powers(BASE, 2 * len(values)), _powers(INVERSE, 2 * len(values))
    inside = ~_BLANK[values]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((values + np.uint64(1)) * _POWERS[: len(values)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, in order; ASCII capitals count as small letters."""
    parts = [_chunk_words(chunk) for chunk in _chunks(text.encode("utf-8", "surrogatepass").lower())]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; a shorter text is one run."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for i in range(size):
            runs = mix(runs * _STEP + words[i : i + len(runs)] + np.uint64(i + 1))
    return np.unique(runs)
