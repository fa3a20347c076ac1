"""Hashes of words and of five-word shingles, inside tasks.

Words are lower-cased from A to Z and split at ASCII white space.
"""

from __future__ import annotations

import numpy as np

from trustweave.llm.shared import SPACES

WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the word hash, and a random number for each byte.
_BASE = 0xD1342543DE82EF93
_BYTE = np.random.default_rng(2024).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), list(SPACES))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes:
    """64-bit hashes of a text's words.

    A word's hash is a polynomial in a fixed base over its bytes' numbers.  All
    words of a text come from one running sum; dividing by the base to the
    word's position makes a hash independent of where the word stands.
    """

    def __init__(self) -> None:
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        powers = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 2**64))

    def of(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes: A-Z only
        n = len(raw)
        if n >= len(self.up):
            self._grow(2 * n)
        white, sums = np.ones(n + 2, bool), np.zeros(n + 1, np.uint64)
        white[1:-1] = _WHITE.take(raw)
        edges = np.flatnonzero(white[1:] != white[:-1])
        start, end = edges[::2], edges[1::2]
        np.cumsum(_BYTE.take(raw) * self.up[:n], out=sums[1:])
        return mixed((sums.take(end) - sums.take(start)) * self.down.take(start) + (end - start).astype(np.uint64))


def windows(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of the shingle at each position; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    wide = min(width, n)
    h = np.full(n - wide + 1, wide, np.uint64)
    for k in range(wide):
        h = h * _ODD + words[k:n - wide + 1 + k]
    return mixed(h)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(windows(hashes.of(text)))
