"""Words of a text and 64-bit hashes of runs of words, as numpy arrays."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, unchanged."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scaled(n: int) -> np.ndarray:
    """n times an odd constant modulo 2^64, as an array of one."""
    return np.array([n * int(ODD) % 2**64], np.uint64)


def run_hashes(hashes: np.ndarray, n: int, starts: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Hashes of the runs of n words at ``starts`` (default: all there are)."""
    base = mix(scaled(seed + 1)) | np.uint64(1)
    out = None
    for k in range(n):
        part = hashes[k : len(hashes) - n + 1 + k] if starts is None else hashes[starts + k]
        out = part.copy() if out is None else out * base + part
    return mix(out + scaled(n))
