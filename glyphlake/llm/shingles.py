"""Word shingles as 64-bit hashes, for Python stages.

Words are runs of anything but ASCII white space, after lower-casing A-Z.  On UTF-8 bytes both
rules are exactly ``bytes.lower`` and ``bytes.split``, so no text is ever decoded.
"""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_MEMO_WORDS = 200_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, memo: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text.

    A text of fewer than ``width`` words is one shingle; one without words has none.
    """
    words = text.lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if n < width:
        # other lengths must not meet: the number of words is mixed in
        out = np.array([n], np.uint64)
        for x in h:
            out = mix(out * _FACTORS[1] + x)
        return out
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out += h[i : n - width + 1 + i] * _FACTORS[i]
        if i < width - 1:
            out = mix(out)
    return np.unique(mix(out))
