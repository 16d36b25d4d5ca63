"""Polynomial fingerprints of all stretches of a sequence, from numpy running sums modulo 2^64.

A stretch's fingerprint is the difference of two running sums, moved to the start by the inverse of a power of
the odd multiplier; so it costs the same at any length, and equal stretches have equal ones wherever they stand.
"""

from __future__ import annotations

import numpy as np

from loomgraph.llm.worker import hold

_BASE = 0x9FB21C651E98DF25


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the multiplier and of its inverse; a worker keeps the longest it has made."""
    table = hold("rolling powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(table[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + n // 4, np.uint64(base))
            steps[0] = 1
            with np.errstate(over="ignore"):
                table[k] = np.multiply.accumulate(steps)
    return table[0], table[1]


def power(exponent: np.ndarray) -> np.ndarray:
    """The multiplier to the power of each exponent, which may be negative or large."""
    out = np.ones(len(exponent), np.uint64)
    left = np.abs(exponent.astype(np.int64))
    with np.errstate(over="ignore"):
        for sign, base in ((1, _BASE), (-1, pow(_BASE, -1, 1 << 64))):
            rest, factor = np.where(np.sign(exponent) == sign, left, 0), np.uint64(base)
            while rest.any():
                out = np.where(rest & 1 == 1, out * factor, out)
                rest, factor = rest >> 1, factor * factor
    return out


class Sums:
    """Running sums of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        self.up, self.down = powers(len(symbols) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(symbols * self.up[: len(symbols)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the stretches [start, end), not mixed."""
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, length: int) -> np.ndarray:
        """Mixed fingerprints of all stretches of one length."""
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)
