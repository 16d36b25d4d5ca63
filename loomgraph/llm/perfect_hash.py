"""A minimal perfect hash over 64-bit keys: levels of bits, each holding the keys that collide with no other."""

from __future__ import annotations

import numpy as np

_SPREAD = 2.0  # bits of a level for each key that reaches it
_LEVELS = 40


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct keys to its own number from 0 to n - 1, in about three bits a key."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bits by level; keys that no level took, sorted
        self.ranks, self.base = [], []
        n = 0
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(ones)
            self.base.append(n)
            n += int(ones[-1])
        self.taken = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(_SPREAD * len(left)) // 64) * 64)
            at = (mix(left, level + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        left = np.sort(left)
        if (left[1:] == left[:-1]).any():
            raise ValueError("two documents have the same 64-bit key")
        return cls(levels, left)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 (or any number, which a fingerprint tells) for keys never put in."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks, base) in enumerate(zip(self.levels, self.ranks, self.base, strict=True)):
            at = (mix(keys[open_], level + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = base + ranks[at[hit]] - 1
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, keys[open_]).clip(max=len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.taken + at[hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), len(self.rest), *[len(b) for b in self.levels]], "<u8")
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels) + self.rest.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash at the start of ``data``, and where it ends."""
        n, rest = (int(x) for x in np.frombuffer(data, "<u8", 2))
        sizes, at, levels = np.frombuffer(data, "<u8", n, 16).astype(int), 16 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels, np.frombuffer(data, "<u8", rest, at)), at + 8 * rest
