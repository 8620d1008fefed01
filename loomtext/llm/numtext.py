"""Vectorised views of text columns: code points, words and hashes as numpy arrays.

Everything here works on one Arrow batch at a time and keeps whole texts; a
batch is cut into slices of bounded size so that very long texts don't pile up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd 64-bit constants of the multiplicative mixers.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + MIX_A
        x = (x ^ (x >> np.uint64(30))) * MIX_B
        x = (x ^ (x >> np.uint64(27))) * MIX_C
        return x ^ (x >> np.uint64(31))


def slices(texts: list[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` characters, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size + n > limit and i > start:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and where each text begins (one entry more than texts)."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    joined = "".join(t for t in texts if t)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


class RollingHash:
    """Rabin-Karp hashes of every window of a sequence, modulo 2**64: fast, and good for choosing windows.

    The symbols are passed through a fixed random permutation of 64-bit numbers first,
    and the window sums through a mixer afterwards: sums of powers alone are weak in their low bits. Texts of a
    doubling pattern collide for any base of this modulus, so what is equal is for ``PrimeHash`` to say.
    """

    BASE = 0xD6E8FEB86659FD93

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            with np.errstate(over="ignore"):
                self.powers = np.concatenate(([np.uint64(1)], np.full(size - 1, self.BASE, np.uint64))).cumprod(dtype=np.uint64)
                back = pow(self.BASE, -1, 1 << 64)
                self.inverse = np.concatenate(([np.uint64(1)], np.full(size - 1, back, np.uint64))).cumprod(dtype=np.uint64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(mix64(symbols.astype(np.uint64)) * self.powers[: len(symbols)], out=sums[1:])
        return sums

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of each window of ``width`` symbols; empty when there are fewer."""
        n = len(sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix64((sums[width:] - sums[:n]) * self.inverse[:n])


class PrimeHash:
    """Rabin-Karp hashes of windows modulo the prime 2**31 - 1 under two bases, together 62 bits.

    Two different windows of n symbols agree with probability (n / 2**31) ** 2 at most, whatever their pattern.
    """

    P = np.uint64((1 << 31) - 1)
    BASES = (1_204_868_929, 2_011_385_111)

    def __init__(self) -> None:
        self.powers = [np.ones(1, np.uint64) for _ in self.BASES]
        self.inverse = [np.ones(1, np.uint64) for _ in self.BASES]

    @classmethod
    def _fold(cls, x: np.ndarray) -> np.ndarray:
        """x below 2**63 to a number below 2**31 + 2 of the same residue."""
        x = (x & cls.P) + (x >> np.uint64(31))
        return (x & cls.P) + (x >> np.uint64(31))

    def _grow(self, n: int) -> None:
        for table, bases in ((self.powers, self.BASES), (self.inverse, [pow(b, -1, int(self.P)) for b in self.BASES])):
            for k, b in enumerate(bases):
                while len(table[k]) < n:
                    t = table[k]
                    table[k] = np.concatenate((t, self._fold(t * np.uint64(pow(b, len(t), int(self.P))))))

    def prefix(self, symbols: np.ndarray) -> list[np.ndarray]:
        n = len(symbols)
        self._grow(n + 1)
        x = mix64(symbols.astype(np.uint64)) >> np.uint64(34)
        out = []
        for power in self.powers:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self._fold(x * power[:n]), out=sums[1:])
            out.append(sums)
        return out

    def at(self, sums: list[np.ndarray], begin: np.ndarray, width: int) -> np.ndarray:
        """Hash of the window of ``width`` symbols at each place of ``begin``."""
        parts = []
        for s, inverse in zip(sums, self.inverse):
            x = self._fold(self._fold(s[begin + width] - s[begin]) * inverse[begin])
            parts.append(np.where(x >= self.P, x - self.P, x))
        return mix64((parts[0] << np.uint64(31)) | parts[1])


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over each run of ``width`` values, in log2(width) passes."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out
