"""Many texts at once as runs of distinct pieces: each distinct piece is worked on once, and results are gathered by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of ``texts`` (no nulls) one after another, and where each text starts, with the end of the last."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def pieces(data: np.ndarray, bounds: np.ndarray, cut: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the number of each piece among them, and each text's first piece; a piece starts where ``cut`` is set and where a text does."""
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    start = np.flatnonzero(cut)
    ends = np.append(start, len(data)).astype(np.int32)
    every = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    coded = every.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(start, bounds)


class Store:
    """What is known of pieces: ids of each row in one pool, how often it was asked for, and more ``columns`` of integers."""

    def __init__(self, limit: int, *columns: str):
        self.limit = limit
        self.row: dict = {}
        self.n = self.used = 0
        self.columns = ("start", "size", "asked", *columns)
        for name in self.columns:
            setattr(self, name, np.zeros(1024, np.int64))
        self.pool = np.zeros(4096, np.uint32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 3 * len(a) // 2), a.dtype)
        out[: len(a)] = a
        return out

    def add(self, ids: list[bytes], **more: list[int]) -> int:
        """Append rows with these ids (little-endian 32-bit) and columns (0 if not given); returns the first one's number."""
        first, n = self.n, self.n + len(ids)
        for name in self.columns:
            setattr(self, name, self._room(getattr(self, name), n))
            getattr(self, name)[first:n] = more.get(name, 0)
        flat = np.frombuffer(b"".join(ids), "<u4")
        self.pool = self._room(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        size = np.array([len(x) for x in ids], np.int64) // 4
        self.size[first:n] = size
        self.start[first:n] = self.used + np.cumsum(size) - size
        self.n, self.used = n, self.used + len(flat)
        return first

    def drop(self, n: int) -> None:
        """Forget the rows from ``n`` on; none of them may be in ``row``."""
        if n < self.n:
            self.used = int(self.start[n])
            self.n = n

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``rows`` one after another, and where each row's end."""
        size = self.size[rows]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[rows] - (ends - size), size)
        at += np.arange(total)
        return self.pool[at], ends

    def often(self, most: int) -> np.ndarray:
        """Mask of the ``most`` rows that were asked for most."""
        keep = np.zeros(self.n, bool)
        keep[np.argsort(-self.asked[: self.n], kind="stable")[:most]] = True
        return keep

    def keep(self, mask: np.ndarray) -> np.ndarray:
        """Forget all other rows; returns the kept rows' new numbers (-1: gone)."""
        old = np.flatnonzero(mask)
        pool, ends = self.gather(old)
        for name in self.columns:
            setattr(self, name, getattr(self, name)[old])
        self.start = ends - self.size
        self.asked //= 2  # old fame fades
        self.pool, self.n, self.used = pool, len(old), len(pool)
        number = np.full(len(mask), -1, np.int64)
        number[old] = np.arange(len(old))
        known = number.tolist()
        self.row = {k: known[r] for k, r in self.row.items() if known[r] >= 0}
        return number
