"""64-bit hashes of words, and of sequences of them by numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a task remembers before it starts anew.
REMEMBERED = 500_000
ODD = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """XXH64 (seed 42) of byte strings, remembered."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequences(each: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` neighbours of each (the hashes of words)."""
    out = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed((out + np.uint64(ODD)) ^ each[i : i + len(out)])
    return out
