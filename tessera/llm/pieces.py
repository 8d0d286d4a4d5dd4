"""Hashes of byte ranges, and a table from them to token ids, in flat arrays."""

from __future__ import annotations

import hashlib

import numpy as np

_LONG = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93))


def range_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of byte ranges, eight bytes at a step; ranges of over 64 bytes by BLAKE2."""
    word = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from any place
    size = end - start
    key = size.astype(np.uint64) * _R
    check = key ^ _P
    live, at, left = np.flatnonzero((size > 0) & (size <= _LONG)), None, None
    at, left = start[live], size[live]
    while len(live):
        w = word[at] & _MASK[np.minimum(left, 8)]
        a, b = (key[live] ^ w) * _P, (check[live] + w) * _Q
        a ^= a >> np.uint64(32)
        b ^= b >> np.uint64(29)
        key[live], check[live] = a * _Q, b * _R
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        key[i], check[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest(), np.uint64)
    return key ^ (key >> np.uint64(31)), check


class IdTable:
    """Token ids of the pieces seen so far, by hash; open addressing, so a lookup is about one access.

    An entry holds both hashes; a piece that shares only the first with an entry gets one of its own, off the table.
    Forgets everything once it holds more than ``keep`` pieces.
    """

    def __init__(self, keep: int = 1_500_000):
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.check, self.offset, self.size = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.int32)
        self._slots(14)

    def _slots(self, bits: int) -> None:
        self.bits, self.row, self.key = bits, np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)

    def full(self, more: int) -> bool:
        return self.n > 0 and (self.n + more > self.keep or self.used > 12 * self.keep)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = (key & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        row = self.row[slot]
        wrong = np.flatnonzero((row >= 0) & (self.key[slot] != key))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            row[wrong] = self.row[slot[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.key[slot[wrong]] != key[wrong])]
        return row

    def append(self, check: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New entries, not yet under a key; ``flat`` has their ids one after another."""
        n, used = self.n + len(size), self.used + len(flat)
        for name, want in (("check", n), ("offset", n), ("size", n), ("ids", used)):
            old = getattr(self, name)
            if len(old) < want:
                new = np.zeros(max(want, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.check[self.n : n], self.size[self.n : n] = check, size
        self.offset[self.n : n] = self.used + np.cumsum(size) - size
        self.ids[self.used : used] = flat
        rows = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        return rows

    def add(self, key: np.ndarray, check: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """New entries under distinct keys that are not there yet."""
        if 2 * (self.n + len(key)) > 1 << self.bits:
            there = self.row >= 0
            old, row = self.key[there], self.row[there]
            self._slots(int(2 * (self.n + len(key))).bit_length() + 1)
            self._file(old, row)
        self._file(key, self.append(check, flat, size))

    def _file(self, key: np.ndarray, row: np.ndarray) -> None:
        slot = (key & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            mine = todo[self.row[slot[todo]] < 0]
            self.row[slot[mine]] = row[mine]
            won = mine[self.row[slot[mine]] == row[mine]]
            self.key[slot[won]] = key[won]
            todo = todo[self.row[slot[todo]] != row[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def lay(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after another, and how many each has."""
        size = self.size[row].astype(np.int64)
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.repeat(self.offset[row] - (total - size), size) + np.arange(n)], size


def rows_of(table: IdTable, parts: list[tuple[bytes, np.ndarray, np.ndarray]], learn) -> list[np.ndarray]:
    """The table's entries of the pieces of each part (data, start, end).

    ``learn`` gives (flat ids, sizes) of a list of (part, start, end) triples; all new pieces of the parts meet it together.
    """
    hashed = [range_hashes(*p) for p in parts]
    found = [table.find(key) for key, _ in hashed]

    def fresh() -> list[np.ndarray]:
        return [np.flatnonzero(row < 0) for row in found]

    new = fresh()
    if sum(map(len, new)):
        many = len(np.unique(np.concatenate([key[i] for (key, _), i in zip(hashed, new)])))
        if table.full(many):
            table.clear()
            found = [np.full(len(key), -1, np.int32) for key, _ in hashed]
            new = fresh()
        key = np.concatenate([k[i] for (k, _), i in zip(hashed, new)])
        check = np.concatenate([c[i] for (_, c), i in zip(hashed, new)])
        where = np.concatenate([np.full(len(i), p) for p, i in enumerate(new)])
        begin, stop = (np.concatenate([p[j][i] for p, i in zip(parts, new)]) for j in (1, 2))
        some, first = np.unique(key, return_index=True)
        flat, size = learn(list(zip(where[first].tolist(), begin[first].tolist(), stop[first].tolist())))
        table.add(some, check[first], flat, size)
        for (k, _), row, i in zip(hashed, found, new):
            row[i] = table.find(k[i])
    for p, ((_, start, end), (_, check), row) in enumerate(zip(parts, hashed, found)):
        clash = np.flatnonzero(table.check[row] != check)
        if len(clash):  # another piece has the first hash: these stay off the table
            row[clash] = table.append(check[clash], *learn([(p, a, b) for a, b in zip(start[clash].tolist(), end[clash].tolist())]))
    return found
