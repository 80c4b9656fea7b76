"""Fast similarity sketching of sets of 64-bit elements.

Rounds 0 to t - 1 throw every element into a random one of t bins with a random value; rounds t to
2t - 1 throw every element into bin ``round - t``.  A bin keeps the smallest (round, value) it saw.
The sketch stops after the first round that leaves no bin empty, which the second half of the rounds
guarantees.  Two sets agree in a coordinate with probability equal to their Jaccard similarity, and
the number of agreements is concentrated as for sampling without replacement.  A set of n elements
takes about n + t log t steps instead of n t.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import mix64

GOLDEN = 0x9E3779B97F4A7C15
MASK = 0xFFFFFFFFFFFFFFFF


def _round_seeds(t: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, t + 1, dtype=np.uint64) * np.uint64(GOLDEN) ^ np.uint64(seed))


class Sketcher:
    def __init__(self, t: int, seed: int = 1):
        self.t, self.seeds = t, _round_seeds(2 * t, seed)

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        """(t,) uint64 coordinates; of the empty set, all ones."""
        t, n = self.t, len(elements)
        out = np.full(t, MASK, np.uint64)
        if not n:
            return out
        empty = np.arange(t)
        full = np.zeros(t, bool)
        at = 0
        many = max(1, min(t, -(-2 * t // n)))  # rounds at once: about two throws a bin
        while len(empty) and at < t:
            rounds = min(many, t - at)
            h = mix64(elements[None, :] ^ self.seeds[at : at + rounds, None])
            # value: the round above the hash's upper bits, so earlier rounds always win
            value = (h >> np.uint64(20)) | (np.arange(at, at + rounds, dtype=np.uint64)[:, None] << np.uint64(48))
            bins = (((h & np.uint64(0xFFFFF)) * np.uint64(t)) >> np.uint64(20)).astype(np.int64).ravel()
            value = value.ravel()
            open_ = ~full[bins]
            np.minimum.at(out, bins[open_], value[open_])
            full = out != MASK
            at += rounds
            empty = np.flatnonzero(~full)
        for b in empty.tolist():
            h = mix64(elements ^ self.seeds[t + b])
            out[b] = (h >> np.uint64(20)).min() | (np.uint64(t + b) << np.uint64(48))
        return out


def bands(sketch: np.ndarray, count: int, width: int) -> np.ndarray:
    """(count,) int64: a key for each run of ``width`` coordinates, distinct between bands."""
    parts = sketch[: count * width].reshape(count, width)
    key = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    for c in range(width):
        key = mix64(key ^ parts[:, c]) + np.uint64(GOLDEN)
    return key.view(np.int64)
