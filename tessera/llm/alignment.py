"""Alignment of two tokenizers' tokens, and corpus-wide document counts of the id pairs that they link.

Tokens of both sides are laid over the same bytes; every stretch between two token ends is a link of one A and
one B occurrence. How many documents hold a pair is counted outside memory: a task radix-partitions its pair-document
records by A id into sorted, compressed runs, which are rows of a written table. Runs of a partition are merged by
heaps, some at a time, up a tree; at its top every A id's pairs lie together, which gives the highest count. The counts
then go down the same tree, to each run only those of its own pairs, and the runs turn them into sums by document.
So no task holds more than a few runs, and a frequent A id is as many runs as there are chunks of documents.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import _PUBLIC, Encoder, MergeTable, batches_of
from tessera.llm.pieces import IdTable, rows_of
from tessera.llm.scratch import Scratch

BLANK = "▁"  #: stands for a space in pieces
DOC_BITS = 20
SEGMENT = 1 << 21  #: characters
KEEP = 500_000  #: distinct pieces that a worker remembers for each side
_LONG = pa.int64()


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on in order."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ListedMerges(MergeTable):
    """Merges as a vocabulary file lists them; a token's id is its merge's place in the order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        byte, special = byte_of(), {t["content"] for t in whole["added_tokens"]}
        as_bytes = lambda t: bytes(byte[c] for c in t)
        super().__init__({as_bytes(t): i for t, i in whole["model"]["vocab"].items() if t not in special})
        pairs = [p.split(" ") if isinstance(p, str) else p for p in whole["model"]["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        keys = np.array([self.ranks[a] * self.width + self.ranks[b] for a, b in pairs], np.int64)
        values = np.array([self.ranks[a + b] for a, b in pairs], np.int32)
        if (np.diff(values) <= 0).any():
            raise ValueError("ids do not follow the order of merges")
        order = np.argsort(keys)
        self.keys, self.values, self.pair = keys[order], values[order], dict(zip(keys.tolist(), values.tolist()))


class PieceEncoder:
    """Ids of texts that begin with a blank, by a sentence piece model.

    No piece of the model has a blank after another character, so no merge reaches over the end of a run of blanks with what
    follows it: such runs are encoded on their own, each once, and told by hash afterwards. ``bad`` is the id of a run whose
    pieces do not add up to its bytes.
    """

    def __init__(self, path: str, keep: int):
        from sentencepiece import SentencePieceProcessor

        self.model, self.table = SentencePieceProcessor(model_file=path), IdTable(keep)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces reach over blanks")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.bad, self.blank = n, self.model.piece_to_id(BLANK)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        rows = [t.encode() for t in texts]
        data = b"".join(rows)
        blank = np.frombuffer(data, np.uint8) == 32
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        first = np.cumsum([0, *map(len, rows)])
        new[first[:-1]] = True
        start = np.flatnonzero(new)
        (row,) = rows_of(self.table, [(data, start, np.append(start[1:], len(data)))], lambda some: self._learn([data[a:b].decode() for _, a, b in some]))
        flat, size = self.table.lay(row)
        place = np.concatenate([[0], np.cumsum(size)])
        return np.split(flat, place[np.searchsorted(start, first[1:-1])])

    def _learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([r[1:] for r in runs], num_threads=1)  # the model puts a blank before each
        found = [x if len(r) > 1 else [self.blank] for r, x in zip(runs, found)]
        found = [x if b"".join([self.bytes_of[i] for i in x]) == r.encode() else [self.bad] for r, x in zip(runs, found)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int32)


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """A text with a blank before it, cut before single blanks between other characters, where tokens of both sides end.

    A piece is about ``size`` characters long, longer only where there is no such place.
    """
    text, out = " " + text, []
    while len(text) > size:
        at = text.find(" ", size)
        while 0 < at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 < at < len(text) - 1:
            break
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


class Aligner:
    """Both sides' tokens of many texts over the same bytes."""

    def __init__(self, path_a: str, path_b: str, keep: int = KEEP):
        table = ListedMerges(path_a)
        self.a, self.b = Encoder(table, _PUBLIC, keep), PieceEncoder(path_b, keep)
        self.size_a = np.array([len(table.bytes_of.get(i, b"")) for i in range(table.width)], np.int64)
        self.size_b = np.array([*map(len, self.b.bytes_of), 0], np.int64)
        self.width = self.b.bad + 1  # a pair is A id * width + B id
        if table.width * self.width >= 1 << 32:
            raise ValueError("id pairs need more than 32 bits")
        ids = max(table.width, self.width)
        self.ids, self.names = ids, np.array([f"{i}{c}" for c in ",|,;" for i in range(ids)], dtype=object)

    def align(self, texts: list[str]):
        """Of each text n_a, n_b, n_groups, n_links and the listed groups, or None where bytes differ; then pair and text number of every link."""
        a, b = self.a.ids(texts), self.b.ids(texts)
        bad = [bool(len(y) and (y == self.b.bad).any()) for y in b]
        none = np.zeros(0, np.int32)
        a, b = ([none if x else y for x, y in zip(bad, side)] for side in (a, b))
        na, nb = (np.array([len(x) for x in side]) for side in (a, b))
        ia, ib = (np.concatenate(side).astype(np.int64) for side in (a, b))
        ea, eb = np.cumsum(self.size_a[ia]), np.cumsum(self.size_b[ib])
        mark = np.zeros(int(ea[-1]) + 1 if len(ea) else 1, np.uint8)
        mark[ea] = 1
        mark[eb] |= 2
        mark = mark[np.flatnonzero(mark)]  # one for every link, at its end
        ends_a, ends_b, both = (mark & 1).astype(bool), mark >= 2, mark == 3
        link_a, link_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        of = np.repeat(np.arange(len(texts)), na)[link_a]
        group = np.cumsum(both) - both
        ga, gb, n = group[ends_a], group[ends_b], int(both.sum())
        ca, cb = np.cumsum(np.bincount(ga, minlength=n)), np.cumsum(np.bincount(gb, minlength=n))
        name = np.empty(len(ia) + len(ib), np.int64)  # A ids of a group, then its B ids
        last_a, last_b = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
        last_a[ca - 1], last_b[cb - 1] = True, True
        name[np.arange(len(ia)) + np.concatenate([[0], cb])[ga]] = ia + self.ids * last_a
        name[np.arange(len(ib)) + ca[gb]] = ib + self.ids * (2 + last_b)
        cut = np.concatenate([[0], np.cumsum(na + nb)])
        n_links, n_groups = np.bincount(of, minlength=len(texts)), np.bincount(of[both], minlength=len(texts))
        rows: list = []
        for i, x in enumerate(bad):
            rows.append(None if x else (int(na[i]), int(nb[i]), int(n_groups[i]), int(n_links[i]), "".join(self.names[name[cut[i] : cut[i + 1]]].tolist())[:-1]))
        return rows, ia[link_a] * self.width + ib[link_b], of


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner a worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def packed(*columns: np.ndarray) -> bytes:
    """Whole-number columns of equal length as one compressed run."""
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns))


def unpacked(run: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(run)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = _starts(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


class Records:
    """Pair-document records of a chunk: sorted runs that are merged when there are some."""

    def __init__(self):
        self.keys, self.n = [], []

    def add(self, pair: np.ndarray, doc: np.ndarray) -> None:
        keys, n = np.unique(pair << DOC_BITS | doc, return_counts=True)
        self.keys.append(keys)
        self.n.append(n)
        if len(self.keys) >= 8:
            keys, n = self.all()
            self.keys, self.n = [keys], [n]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return summed(np.concatenate([none, *self.keys]), np.concatenate([none, *self.n]))

    def runs(self, width: int, parts: int, without: list[int]) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, pairs, docs): by radix of the A id, in A-major order; pairs with their document counts, and each pair's documents with their links."""
        keys, n = self.all()
        if without:
            ok = ~np.isin(keys & ((1 << DOC_BITS) - 1), without)
            keys, n = keys[ok], n[ok]
        part = ((keys >> DOC_BITS) // width % parts).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order], part[order]
        at = np.append(_starts(part), len(keys))
        for lo, hi in zip(at[:-1], at[1:]):
            pair, doc = keys[lo:hi] >> DOC_BITS, (keys[lo:hi] & ((1 << DOC_BITS) - 1)).astype("<u4")
            first = _starts(pair)
            yield int(part[lo]), packed(np.diff(pair[first], prepend=0).astype("<u4"), np.diff(first, append=hi - lo).astype("<i8")), packed(doc, n[lo:hi].astype("<u4"))


_FIELDS = [
    ("chunk", _LONG), ("i", pa.int32()), ("doc_id", _LONG), ("n_a", _LONG), ("n_b", _LONG), ("n_groups", _LONG), ("n_links", _LONG), ("groups_sha256", pa.string()),
    ("part", pa.int32()), ("pairs", pa.binary()), ("docs", pa.binary()),
]
_ROWS = "chunk long, i int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, pairs binary, docs binary"


class Chunk:
    """Documents of some megabytes of a task: their rows, and their runs when it is full."""

    def __init__(self, number: int):
        self.number, self.ids, self.n, self.sha, self.bad = number, [], [], [], set()
        self.records, self.size = Records(), 0

    def open(self, doc_id: int | None) -> int:
        self.ids.append(doc_id)
        self.n.append([0, 0, 0, 0])
        self.sha.append(None)
        return len(self.ids) - 1

    def add(self, al: Aligner, segments: list[tuple[int, str]]) -> None:
        """Segments of documents in order, encoded some megabytes at a time."""
        at = 0
        for texts in batches_of([t for _, t in segments], SEGMENT):
            self._align(al, segments[at : at + len(texts)])
            at += len(texts)

    def _align(self, al: Aligner, batch: list[tuple[int, str]]) -> None:
        rows, pair, of = al.align([t for _, t in batch])
        doc = np.array([i for i, _ in batch], np.int64)
        self.records.add(pair, doc[of])
        for (i, text), row in zip(batch, rows):
            self.size += len(text)
            if row is None:
                self.bad.add(i)
                continue
            self.n[i] = [x + y for x, y in zip(self.n[i], row)]
            if self.sha[i] is None:
                self.sha[i] = hashlib.sha256()
            else:
                self.sha[i].update(b";")
            self.sha[i].update(row[4].encode())

    def rows(self, al: Aligner, parts: int) -> Iterator[pa.RecordBatch]:
        none = [0, 0, 0, 0]
        n = [none if i in self.bad else x for i, x in enumerate(self.n)]
        sha = ["" if s is None or i in self.bad else s.hexdigest() for i, s in enumerate(self.sha)]
        docs = [[self.number] * len(n), [*range(len(n))], self.ids, *zip(*n), sha]
        yield self._batch([*docs, *([None] * len(n) for _ in range(3))])
        for part, pairs, docs in self.records.runs(al.width, parts, sorted(self.bad)):
            yield self._batch([[self.number], *([None] for _ in range(7)), [part], [pairs], [docs]])

    @staticmethod
    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _FIELDS)], names=[k for k, _ in _FIELDS])


def _chunks(path_a: str, path_b: str, parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, seq = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        chunk, wait, waiting = Chunk(seq), [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = chunk.open(doc_id)
                wait += [(i, s) for s in segments(text)] if text else []
                waiting += len(text or "")
                full = chunk.size + waiting >= size or i + 1 >= 1 << DOC_BITS
                if waiting >= SEGMENT or full:
                    chunk.add(al, wait)
                    wait, waiting = [], 0
                if full:
                    yield from chunk.rows(al, parts)
                    seq += 1
                    chunk = Chunk(seq)
        chunk.add(al, wait)
        if chunk.ids:
            yield from chunk.rows(al, parts)

    return run


def heap_merge(runs: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) of one A id after another, over runs in A-major order; the heap holds each run's next A id."""
    cuts = [np.append(_starts(pair // width), len(pair)).tolist() for pair, _ in runs]
    heap = [(int(pair[0]) // width, r, 0) for r, (pair, _) in enumerate(runs) if len(pair)]
    heapq.heapify(heap)
    while heap:
        a, found = heap[0][0], []
        while heap and heap[0][0] == a:
            _, r, k = heap[0]
            pair, n = runs[r]
            lo, hi = cuts[r][k], cuts[r][k + 1]
            found.append((pair[lo:hi], n[lo:hi]))
            if hi < len(pair):
                heapq.heapreplace(heap, (int(pair[hi]) // width, r, k + 1))
            else:
                heapq.heappop(heap)
        yield found[0] if len(found) == 1 else summed(np.concatenate([p for p, _ in found]), np.concatenate([n for _, n in found]))


def _read(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = unpacked(run, "<u4", "<i8")
    return np.cumsum(step, dtype=np.int64), n


def _upward(width: int, top: bool):
    """Runs of one node merged into one; at the top with whether each pair has its A id's highest count."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pairs, counts, best = [], [], []
        for p, n in heap_merge([_read(x) for x in rows["pairs"].to_pylist()], width):
            pairs.append(p)
            counts.append(n)
            best.append(n == n.max())
        pair = np.concatenate(pairs)
        columns = [np.diff(pair, prepend=0).astype("<u4"), np.concatenate(counts).astype("<i8"), *([np.concatenate(best).astype(np.uint8)] if top else [])]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], _LONG), "pairs": pa.array([packed(*columns)], pa.binary())})

    return run


def _downward(leaf: bool):
    """A node's counts dealt out to its runs, to each those of its own pairs; of the lowest runs, sums by document."""

    def run(above: pa.Table, below: pa.Table) -> pa.Table:
        step, count, best = unpacked(above["pairs"][0].as_py(), "<u4", "<i8", "u1")
        known = np.cumsum(step, dtype=np.int64)
        out = []
        for i in range(below.num_rows):
            own, n = _read(below["pairs"][i].as_py())
            at = np.searchsorted(known, own)
            if leaf:
                doc, links = unpacked(below["docs"][i].as_py(), "<u4", "<u4")
                at, links = np.repeat(at, n), links.astype(np.int64)
                docs, where = np.unique(doc, return_inverse=True)
                most, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(most, where, links * best[at])
                np.add.at(total, where, links * count[at])
                out.append(packed(docs.astype("<u4"), most, total))
            else:
                out.append(packed(np.diff(own, prepend=0).astype("<u4"), count[at], best[at]))
        return pa.table({"part": below["part"], "node": below["node"], "pairs": pa.array(out, pa.binary())})

    return run


def _sums(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a chunk with what all parts have counted for them."""
    at = rows["i"].to_numpy()
    most, total = (np.zeros(int(at.max(initial=-1)) + 1, np.int64) for _ in range(2))
    for x in found["pairs"].to_pylist():
        doc, m, t = unpacked(x, "<u4", "<i8", "<i8")
        most[doc] += m
        total[doc] += t
    return rows.drop_columns(["chunk", "i"]).append_column("n_best", pa.array(most[at])).append_column("count_sum", pa.array(total[at]))


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, parts: int = 32, fan: int = 64, chunk: int = 8 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of (doc_id, text).

    path_a: a byte-level vocabulary with its merges; path_b: a sentence piece model. Null and empty texts, and those whose pieces do
    not add up to their bytes (they hold U+2581), have zeros and an empty digest. Rows are documents of their own, also where ids
    repeat or are null; other columns are ignored. Texts are encoded whole, long ones in segments at ends of tokens of both sides.

    chunk: characters of documents whose records are sorted together; a run is a ``parts``-th of them by A id. fan: about as many runs meet in
    a task. The counts of a part, at most the A ids times the B ids over ``parts``, are one row: 100 million distinct pairs make rows of some 15 MB.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = scratch.save(rows.mapInArrow(_chunks(path_a, path_b, parts, chunk), _ROWS))
    stats = whole.where("part is null").select("doc_id", "chunk", "i", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    width = _width(path_b)
    n = stats.select("chunk").distinct().count()
    run, kind = F.col("pairs"), "part int, node long, pairs binary"
    leaves = whole.where("part is not null").select("part", F.col("chunk").alias("node"), "pairs", "docs")
    levels, nodes = [], max(1, -(-n // fan))
    parent = F.pmod(F.xxhash64("node"), F.lit(nodes)).cast("long")
    level = leaves
    while True:
        levels.append((level.withColumn("parent", parent), level is leaves))
        up = levels[-1][0].select("part", F.col("parent").alias("node"), run).groupBy("part", "node").applyInArrow(_upward(width, nodes == 1), kind)
        level = scratch.save(up)
        if nodes == 1:
            break
        nodes = -(-nodes // fan)
        parent = F.col("node") % nodes
    for below, leaf in reversed(levels):
        left = level.select("part", F.col("node").alias("parent"), "pairs").groupBy("part", "parent")
        level = scratch.save(left.cogroup(below.groupBy("part", "parent")).applyInArrow(_downward(leaf), kind))
    found = level.select(F.col("node").alias("chunk"), "pairs")
    scratch.keep(whole, level)
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return stats.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_sums, out)


def _width(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size() + 1
