"""Words of UTF-8 texts as arrays of 64-bit hashes, for operators that compare passages."""

from __future__ import annotations

import numpy as np
import xxhash

from millrace.llm.common import held

_A = np.uint64(0x9E3779B97F4A7C15)
_MOST_WORDS = 200_000


class _Words(dict):
    """Hashes of the words met so far, in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(held("words", _Words).__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words, of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = words[: n - k + 1].copy()
    for i in range(1, k):
        h = h * _A + words[i : n - k + 1 + i]
    return np.unique(mix(h + np.uint64(size - k)))


_INVERSE = pow(int(_A), -1, 1 << 64)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least of an odd factor and of its inverse, modulo 2**64."""
    if len(_tables[0]) < n + 1:
        size = max(n + 1, 2 * len(_tables[0]), 1024)
        for k, factor in enumerate((int(_A), _INVERSE)):
            _tables[k] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, factor, np.uint64)))
    return _tables[0], _tables[1]


def running(h: np.ndarray) -> np.ndarray:
    """Running sums from which run_hashes takes the hash of any run."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h))[0][: len(h)], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """For each run from start to end, a sum that depends on its elements and their order in it alone."""
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
