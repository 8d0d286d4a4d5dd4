"""Whole-text word scanning and hashing with numpy, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


def chunks(*columns: list, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` characters; one row at least, so a long text is a chunk of its own."""
    start, total, rows = 0, 0, len(columns[0])
    for i in range(rows):
        n = sum(len(c[i] or "") for c in columns)
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < rows:
        yield start, rows


@dataclass
class Scan:
    """Bytes of several texts, each followed by a separator, with their words."""

    data: np.ndarray  # uint8, A-Z lower-cased
    start: np.ndarray  # of each word
    end: np.ndarray
    doc: np.ndarray  # row of each word
    sums: np.ndarray  # prefix sums for hashes of byte ranges

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end: equal bytes give equal hashes anywhere."""
        return mix((self.sums[end] - self.sums[start]) * _power(len(self.data))[1][start])


def scan(texts: list, separators: np.ndarray = _SPACE) -> Scan:
    """Words are the runs of bytes that are not separators; a null text has none."""
    rows = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(rows) + b"\n", dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])[:-1]]).astype(np.int64)
    gap = separators[data]
    data = np.where(gap, np.uint8(32), data)
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    doc = np.searchsorted(begins, start, side="right") - 1
    up = _power(len(data))[0][: len(data)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up, dtype=np.uint64)])
    return Scan(data, start, end, doc, sums)
