"""Minimal perfect hashing of 64-bit key hashes, by levels of collision-free bit arrays.

Level by level, each remaining key is hashed to one of ``GAMMA * n`` positions.  A key that has its
position for itself takes it; the others go down a level.  A key's slot is the number of taken
positions before its own, over all levels: a bijection of n keys onto 0..n-1 in about 3 bits a key.
All of it is array arithmetic; no key is visited by a Python loop.
"""

from __future__ import annotations

import struct

import numpy as np

from tidemark.llm.common import mix64

GAMMA = 2.0
LEVELS = 64


def key_hashes(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit integer keys; injective, so distinct keys never collide."""
    return mix64(np.asarray(keys).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _positions(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(hashes ^ np.uint64((0xA24BAED4963EE407 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


class MinimalPerfectHash:
    """Slots of distinct 64-bit hashes.  For a hash outside the set, ``slots`` gives -1 or some slot:
    whoever stores what the slots hold must compare it, in full or by a fingerprint."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # one boolean array a level
        ends = np.cumsum([int(x.sum()) for x in levels]) if levels else np.zeros(0, np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(x)[:-1]]).astype(np.int64) + (ends[i - 1] if i else 0) for i, x in enumerate(levels)]
        self.n = int(ends[-1]) if levels else 0

    @classmethod
    def build(cls, hashes: np.ndarray) -> MinimalPerfectHash:
        left = np.asarray(hashes, dtype=np.uint64)
        levels: list[np.ndarray] = []
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("hashes are not distinct")
            size = max(2, int(GAMMA * len(left)))
            at = _positions(left, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        hashes = np.asarray(hashes, dtype=np.uint64)
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        for i, taken in enumerate(self.levels):
            if not len(open_):
                break
            at = _positions(hashes[open_], i, len(taken)).astype(np.int64)
            hit = taken[at]
            out[open_[hit]] = self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        """Little-endian: number of levels, then of each its size in bits and the bits."""
        parts = [struct.pack("<I", len(self.levels))]
        for x in self.levels:
            parts.append(struct.pack("<Q", len(x)) + np.packbits(x, bitorder="little").tobytes())
        return b"".join(parts)

    @classmethod
    def load(cls, raw: bytes) -> MinimalPerfectHash:
        (count,), at, levels = struct.unpack_from("<I", raw), 4, []
        for _ in range(count):
            (size,) = struct.unpack_from("<Q", raw, at)
            nbytes = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, nbytes, at + 8), count=size, bitorder="little").astype(bool))
            at += 8 + nbytes
        return cls(levels)
