"""Polynomial hashes of byte spans, modulo 2 ** 64, for whole arrays of spans at once."""

import numpy as np

_BASE = 0x5851F42D4C957F2D
_tables = {}


def _powers(n):
    """Powers of the odd base and of its inverse."""
    if len(_tables.get("up", ())) < n:
        n = 1 << (n - 1).bit_length()
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


class Spans:
    """Hashes of spans of one byte array: equal bytes give equal hashes wherever they stand."""

    def __init__(self, data):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        wide = data.astype(np.uint64)
        wide += np.uint64(1)
        wide *= up[:len(data)]
        np.cumsum(wide, out=self._sums[1:])

    def hash(self, start, stop):
        return (self._sums[stop] - self._sums[start]) * self._down[start]


def mix(hashes):
    """Spread every bit of 64-bit numbers over the whole number."""
    hashes = hashes ^ (hashes >> np.uint64(32))
    hashes = hashes * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))
