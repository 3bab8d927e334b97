"""Word shingles as sorted arrays of 64-bit hashes, for use inside tasks.

Words are the maximal runs of other characters than the six ASCII spaces, A-Z lower-cased; a shingle is five words in
a row, or the whole sequence where a text has fewer. Long texts cost memory in proportion to their words.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word -> hash, remembering up to 200,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    def __init__(self):
        self.hashes = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes of a text, ascending; empty for a text without words."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.int64)
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(len(w), WORDS)
        acc = w[: len(w) - n + 1] * _K[0]
        for k in range(1, n):
            acc += w[k : len(w) - n + 1 + k] * _K[k]
        if n < WORDS:
            acc += np.uint64(n)
        acc = mix(acc).view(np.int64)
        acc.sort()
        return acc[np.concatenate(([True], acc[1:] != acc[:-1]))] if len(acc) > 1 else acc


def set_hashes(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of the set (signed)."""
    out = []
    for seed in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)):
        x = mix(tokens.view(np.uint64) ^ seed)
        out.append(x.sum(dtype=np.uint64) + np.uint64(len(tokens)))
    return tuple(mix(np.array(out, np.uint64)).view(np.int64).tolist())


def node_name(tokens: np.ndarray, twice: frozenset) -> int:
    """The first hash of the set, or the second where the first is among `twice`."""
    h, g = set_hashes(tokens)
    return g if h in twice else h
