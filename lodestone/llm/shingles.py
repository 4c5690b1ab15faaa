"""Word shingles as 64-bit hashes.

Words are cut at ASCII white space; A to Z count as a to z.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import words_of

SHINGLE = 5
#: Words whose hashes a task remembers.
REMEMBERED = 250_000


def _odd(i: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(b"place", i) | 1)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _odd(0)
    for k in range(1, size):
        out += (words[k : k + n] ^ (words[k : k + n] >> np.uint64(29))) * _odd(k)
    return out ^ (out >> np.uint64(32))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingles of a text; a text of fewer than SHINGLE words has one of all its words, an empty text none."""
    words = hashes.of(text)
    return np.unique(shingles(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(0, np.uint64)
