"""Character n-grams of many words at once, as hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

#: Odd multipliers for the hashes (fixed values; a stored model depends on them).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
EDGE_LEFT, EDGE_RIGHT = "<", ">"


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = (h ^ (h >> np.uint64(31))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def points(words: list[str], left: str = EDGE_LEFT, right: str = EDGE_RIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the edged words after one another, and where each word starts (and the end)."""
    flat = np.frombuffer("".join([f"{left}{w}{right}" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + len(left) + len(right)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def ngrams(flat: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside the words, and the word of each."""
    sizes = np.maximum(np.diff(starts) - (n - 1), 0)
    word = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[:-1][word]
    h = np.full(len(at), n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h + flat[at + k] + np.uint64(1)) * STEP
            h ^= h >> np.uint64(32)
        return mix(h), word
