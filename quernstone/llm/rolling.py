"""Hashes of all windows of a sequence at once, in numpy."""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Windows:
    """Window hashes of many sequences; keeps the powers of its base."""

    def __init__(self, which: int = 0) -> None:
        self.base = np.uint64(_ODD[which] | 1)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.which = np.uint64(which + 1)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            one = np.ones(n, np.uint64)
            self.up, self.down = one.copy(), one.copy()
            self.up[1:], self.down[1:] = self.base, self.back
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)

    def prefix(self, items: np.ndarray) -> np.ndarray:
        """Prefix sums from which the hash of any window follows."""
        self._grow(len(items) + 1)
        out = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(mix(items.astype(np.uint64) * np.uint64(2) + self.which) * self.up[: len(items)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of every window of k items."""
        n = len(prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[k:] - prefix[:n]) * self.down[:n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours, in log2(w) passes."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
