"""Byte-level BPE by merge replay over the distinct pieces of many documents at once.

The distinct pre-tokens of some 12 MB of text that a worker has not met before lie one after another in flat arrays;
an inverted index from token pair to positions holds where each pair stands. Merges are applied in rank order,
each to all its positions together, and only the two neighbours of a merged pair are looked up again.
What a worker has learned it keeps, so the replay is over a task's part of the corpus and not over all of it:
one table of the corpus's pieces would have to meet every piece of every text in a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pieces import IdTable, rows_of
from tessera.llm.words import chunks

NONE = np.int32(1 << 30)
_FEW = 24
LETTER, DIGIT, OTHER, SPACE = range(4)


#: Fixed value: the split pattern of the public byte-level vocabularies, which ``Splitter`` implements.
_PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class MergeTable:
    """Ranks by bytes, and the rank of each pair of tokens that merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.width = max(ranks.values()) + 1
        keys, values = [], []
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.pair = dict(zip(keys, values))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def one_by_one(self, piece: bytes) -> list[int]:
        """The plain definition: merge the leftmost pair of lowest rank until none is left."""
        parts = [int(self.byte[b]) for b in piece]
        while len(parts) > 1:
            rank, i = min((self.pair.get(a * self.width + b, int(NONE)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NONE:
                break
            parts[i : i + 2] = [rank]
        return parts

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces one after another, and how many each has; a piece that is a token itself is that token."""
        own = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        size = (own >= 0).astype(np.int32)
        todo = [i for i in np.flatnonzero(own < 0).tolist() if pieces[i]]
        ids, n = self._replay([pieces[i] for i in todo]) if todo else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        size[todo] = n
        flat = np.zeros(int(size.sum()), np.int32)
        place = np.cumsum(size) - size
        flat[place[own >= 0]] = own[own >= 0]
        flat[np.repeat(place[todo] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, size

    def _replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        length = np.array([len(p) for p in pieces])
        first = np.cumsum(length) - length
        tok = self.byte[data]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[first + length - 1] = -1
        prv[first] = -1
        alive, mark = np.ones(n, bool), np.zeros(n, bool)
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.lookup(tok[inner], tok[inner + 1])
        index: dict[int, list] = {}
        heap: list[int] = []
        odd: set[int] = set()

        def add(at: np.ndarray, ranks: np.ndarray, now: int) -> None:
            """Files positions under their pairs' ranks."""
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(ranks)]):
                r = int(ranks[lo])
                if r == NONE:
                    break
                if r <= now:  # an earlier merge than this one: the order inside the piece matters
                    odd.update(np.searchsorted(first, at[lo:hi], side="right") - 1)
                    continue
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)

        live = np.flatnonzero(rank != NONE)
        add(live, rank[live], -1)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            at = at[rank[at] == r]
            many = len(at) > _FEW
            if many:
                mark[at] = True
                many = not mark[nxt[at]].any()  # else two places of the pair overlap
                mark[at] = False
            if many:
                alive[nxt[at]] = False
                self._merge_many(at, r, tok, nxt, prv, rank, add)
            else:
                self._merge_few(sorted(at.tolist()), r, tok, nxt, prv, rank, alive, index, heap, odd, first)
        whole = np.flatnonzero(alive)
        flat = tok[whole]
        cut = np.searchsorted(whole, np.append(first, n))
        if not odd:
            return flat, np.diff(cut)
        parts = np.split(flat, cut[1:-1])
        for i in odd:
            parts[i] = np.array(self.one_by_one(pieces[i]), np.int32)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _merge_many(self, at, r, tok, nxt, prv, rank, add) -> None:
        second = nxt[at]
        after = nxt[second]
        tok[at] = r
        nxt[at] = after
        rank[second] = NONE
        rank[at] = NONE
        prv[after[after >= 0]] = at[after >= 0]
        before = prv[at]
        touched = np.concatenate([at[after >= 0], before[before >= 0]])
        new = self.lookup(tok[touched], tok[nxt[touched]])
        rank[touched] = new
        add(touched, new, r)

    def _merge_few(self, at, r, tok, nxt, prv, rank, alive, index, heap, odd, first) -> None:
        for p in at:
            if rank[p] != r:  # its first token went into the pair before it
                continue
            q = nxt[p]
            n = nxt[q]
            tok[p] = r
            nxt[p] = n
            alive[q] = False
            rank[p] = rank[q] = NONE
            if n >= 0:
                prv[n] = p
            for x in (prv[p], p):
                if x >= 0 and nxt[x] >= 0:
                    new = self.pair.get(int(tok[x]) * self.width + int(tok[nxt[x]]), int(NONE))
                    rank[x] = new
                    if new == NONE or new == r:
                        if new == r:
                            odd.add(int(np.searchsorted(first, x, side="right") - 1))
                        continue
                    if new < r:
                        odd.add(int(np.searchsorted(first, x, side="right") - 1))
                        continue
                    one = np.array([x])
                    if new in index:
                        index[new].append(one)
                    else:
                        index[new] = [one]
                        heapq.heappush(heap, new)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, map(int, ids)))


class Splitter:
    """Starts of the matches of the public split pattern, found for many texts at once.

    The pattern takes contractions ('s 't 're 've 'm 'll 'd), runs of letters, of digits and of other
    characters, each with one blank before it, and white space up to the last before a non-space.
    """

    def __init__(self):
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kind = np.full(0x110000, OTHER, np.uint8)
        for k, what in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(what, points):
                lo, hi = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
                kind[lo : hi + 1] = k
        kind[0xD800:0xE000] = OTHER
        self.kind = kind

    def starts(self, point: np.ndarray, first: np.ndarray) -> np.ndarray:
        """point: code points of the texts, a separator after each; first: where each text begins.

        True where a piece begins; the separators, too, are pieces (callers drop them).
        """
        n = len(point)
        kind = self.kind[point].astype(np.int8)
        fence = np.zeros(n, bool)
        fence[np.append(first[1:], n) - 1] = True  # the separators
        kind[fence] = -1
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        blank = point == 32
        blank[fence] = False
        after = np.append(kind[1:], -1)
        solid = (kind != SPACE) & (kind >= 0)
        led = np.zeros(n, bool)  # runs that take the blank before them
        led[1:] = new[1:] & solid[1:] & blank[:-1]
        start = new & ~led
        last = (kind == SPACE) & (after != SPACE) & (after >= 0)  # white space just before a non-space
        start |= last
        quote = np.flatnonzero((point == 39) & start)
        if len(quote):
            padded = np.concatenate([point, np.zeros(3, point.dtype)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, np.array([115, 116, 109, 100], point.dtype))  # s t m d
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re ve ll
            for hit, size in ((short, 2), (long, 3)):
                at = quote[hit & (point[quote] == 39)]
                start[at + 1] = False
                then = at + size
                then = then[then < n]
                start[then] |= kind[then] == LETTER
        return start


class Encoder:
    """Encodes whole texts: the distinct pieces of many texts are replayed together, then laid out by document."""

    def __init__(self, table: MergeTable, pattern: str, keep: int = 1_500_000):
        self.table, self.words = table, IdTable(keep)
        self.find = regex.compile(pattern).findall
        self.splitter = Splitter() if pattern == _PUBLIC else None
        self.names = np.array([str(i) for i in range(table.width)], dtype=object)
        self.token = np.array([table.bytes_of.get(i, b"") for i in range(table.width)], dtype=object)

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """Byte range and text number of every piece, with two hashes."""
        if self.splitter is None:
            pieces = [[p.encode() for p in self.find(t)] for t in texts]
            data = b"".join(b for ps in pieces for b in ps)
            size = np.array([len(b) for ps in pieces for b in ps], np.int64)
            end = np.cumsum(size)
            return end - size, end, data, np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
        whole = "\0".join(texts) + "\0"
        point = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        length = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(length) - length
        begins = np.flatnonzero(self.splitter.starts(point, first))
        width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)])
        doc = np.searchsorted(first, begins, side="right") - 1
        end = np.append(begins[1:], len(point))
        piece = begins != first[doc] + length[doc] - 1  # not a separator
        return byte[begins[piece]], byte[end[piece]], whole.encode(), doc[piece]

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The table's entry and the text's number of every piece."""
        parts, docs = [], []
        for lo, hi in chunks(texts):
            start, end, data, doc = self._cut(texts[lo:hi])
            parts.append((data, start, end))
            docs.append(doc + lo)
        rows = rows_of(self.words, parts, lambda some: self.table.encode([parts[p][0][a:b] for p, a, b in some]))
        return np.concatenate(rows), np.concatenate(docs)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        row, doc = self._rows(texts)
        flat, size = self.words.lay(row)
        return np.split(flat, np.cumsum(self._per_text(doc, size, len(texts)))[:-1])

    def lengths(self, texts: list[str]) -> np.ndarray:
        row, doc = self._rows(texts)
        return self._per_text(doc, self.words.size[row], len(texts))

    @staticmethod
    def _per_text(doc: np.ndarray, size: np.ndarray, texts: int) -> np.ndarray:
        return np.bincount(doc, weights=size, minlength=texts).astype(np.int64)  # sums below 2**53 are exact

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.ids(texts)] if texts else []

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of tokens, SHA-256 of its ids, SHA-256 of what its ids decode to."""
        out = []
        for x in self.ids(texts) if texts else []:
            listed, decoded = ",".join(self.names[x]), b"".join(self.token[x])
            out.append((len(x), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(MergeTable.load(path), pattern)
    return _loaded[path, pattern]


def batches_of(texts: list[str], size: int = 12 << 20) -> Iterator[list[str]]:
    part, total = [], 0
    for t in texts:
        part.append(t)
        total += len(t)
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids array<int>, decoded binary of every row.

    A null or empty text has no tokens and decodes to nothing. Rows are independent, so repeated and null
    doc_ids keep their rows; other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            at = 0
            for texts in batches_of([t or "" for t in b.column(1).to_pylist()]):
                ids = e.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([e.table.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "token_ids", "decoded"],
                )
                at += len(texts)

    return _rows(docs).mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode_documents``, with token counts and SHA-256 of ids and decoded bytes in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            at = 0
            for texts in batches_of([t or "" for t in b.column(1).to_pylist()]):
                rows = e.digests(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(rows)), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(rows)

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of token id arrays; bytes that are not UTF-8 become the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path, pattern).table
        for b in batches:
            texts = [None if x is None else table.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
