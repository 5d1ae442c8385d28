"""Minimal perfect hash of 64-bit keys in numpy, by cascaded collision-free levels.

At each level the keys left are hashed into a bit array of ``GAMMA`` slots a key; a
key alone in its slot is settled there, the others go to the next level. A key's
number is the count of settled slots before its own, over all levels: the numbers are
0..n-1 without gaps. Keys that no level can tell apart (equal 64-bit hashes) are kept
in a sorted list by their second hash.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA, LEVELS = 2.0, 40


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer, seeded."""
    z = x.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Numbers for a fixed set of keys, given as two 64-bit hashes each."""

    def __init__(self, levels: list[np.ndarray], spare: np.ndarray):
        self.levels, self.spare = levels, spare
        self.starts = np.cumsum([0, *(int(bits.sum()) for bits in levels)])
        self.ranks = [np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]) for bits in levels]
        self.size = int(self.starts[-1]) + len(spare)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> "PerfectHash":
        """Keys must be distinct as pairs."""
        left, levels = np.arange(len(first)), []
        while len(left) and len(levels) < LEVELS:
            slots = max(1, int(GAMMA * len(left)))
            at = (mix(first[left], len(levels)) % np.uint64(slots)).astype(np.int64)
            alone = np.bincount(at, minlength=slots) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(second[left].astype(np.uint64)))

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are certainly foreign."""
        out = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for k, bits in enumerate(self.levels):
            if not len(left):
                return out
            at = (mix(first[left], k) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = self.starts[k] + self.ranks[k][at[here]]
            left = left[~here]
        if len(left) and len(self.spare):
            at = np.searchsorted(self.spare, second[left].astype(np.uint64))
            at = np.minimum(at, len(self.spare) - 1)
            here = self.spare[at] == second[left].astype(np.uint64)
            out[left[here]] = self.starts[-1] + at[here]
        return out

    def dump(self, columns: dict[str, np.ndarray]) -> bytes:
        """One file: the levels as bits, then the columns in order of the numbers."""
        parts = {f"level{k}": np.packbits(bits) for k, bits in enumerate(self.levels)}
        sizes = np.array([len(bits) for bits in self.levels], np.int64)
        out = io.BytesIO()
        np.savez(out, sizes=sizes, spare=self.spare, **parts, **{f"col_{k}": v for k, v in columns.items()})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple["PerfectHash", dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data)) as z:
            levels = [np.unpackbits(z[f"level{k}"], count=int(n)).astype(bool) for k, n in enumerate(z["sizes"])]
            return cls(levels, z["spare"]), {k[4:]: z[k] for k in z.files if k.startswith("col_")}
