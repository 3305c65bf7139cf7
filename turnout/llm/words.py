"""Word hashes of many texts at once, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240817)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_BACK = pow(_BASE, -1, 2**64)
MIX = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes inside words: of the letters-and-digits kind, and of all but ASCII white space.
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
NONSPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 24:
            _powers[base] = have
    return have[:n]


class Words:
    """The words of some texts: 64-bit hashes, places in the bytes and bounds per text."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, lower: bool):
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.bytes = joined
        low = _LOWER[joined] if lower else joined
        word = inside[low]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.starts, self.stops = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.cumsum(sizes) - sizes
        self.bounds = np.searchsorted(self.starts, np.append(self.text_starts, len(joined)))
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        value = _VALUE[low] * _power(_BASE, len(low))
        value *= word
        sums = np.add.reduceat(value, self.starts) * _power(_BACK, len(low))[self.starts]
        sums ^= sums >> np.uint64(31)
        sums *= MIX
        self.hashes = sums ^ (sums >> np.uint64(29))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def prefixes(self, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """Hashes of each word's first bytes, one array for each size; zero for words that
        aren't longer."""
        out, sums = [], np.zeros(len(self.starts), np.uint64)
        power = _power(_BASE, max(sizes))
        long = self.stops - self.starts
        for j in range(max(sizes)):
            sums += _VALUE[_LOWER[self.bytes[np.minimum(self.starts + j, len(self.bytes) - 1)]]] * power[j]
            if j + 1 in sizes:
                mixed = (sums ^ sums >> np.uint64(31)) * (MIX + np.uint64(2 * j + 2))
                out.append(np.where(long > j + 1, mixed ^ mixed >> np.uint64(29), np.uint64(0)))
        return out
