"""Words of many texts at once, as positions and 64-bit hashes, by numpy over the texts' bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: A-Z as a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LOWERED = _TABLE[LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(m, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words (runs of non-space) of ``texts``: start and end bytes in ``data``, lower-cased hash, and ``first``, the index of each text's first word."""

    def __init__(self, texts: list[bytes]):
        blob = b" " + b" ".join(texts) + b" "
        self.data = np.frombuffer(blob, np.uint8)
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_LOWERED[self.data] * power[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        #: Byte at which each text starts, and one past the separator after the last.
        self.offset = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.start, self.offset)
