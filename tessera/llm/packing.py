"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of its documents' tokens. Round-robin runs in slots: at each slot every queue with
tokens left earns its share of a token, and a queue whose credit reaches a whole token is served. What a
queue has earned and not been served is its deficit; it is carried from slot to slot, window to window
and partition to partition. With whole-number weights the tokens served up to any slot are a floor, so
every task computes the deficits at its own place instead of waiting for the tasks before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.bpe import batches_of
from tessera.llm.pieces import IdTable, rows_of
from tessera.llm.scratch import Scratch

BITS = 18
UNIT = 1 << BITS  #: weights are shares in this unit
BLOCK = 1 << 20  #: numbers in a table of counts
_encoders: dict = {}


def _earned(slot: np.ndarray, weight: np.ndarray, start: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Whole tokens and rest of (slot * weight + start) / UNIT, with the slot in two parts: the product itself may not fit 64 bits."""
    rest = (slot & (UNIT - 1)) * weight + start
    return (slot >> BITS) * weight + (rest >> BITS), rest & (UNIT - 1)


def _slot_of(tokens: np.ndarray, weight: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
    """The first slot in which so many tokens are earned."""
    q, r = np.divmod(tokens, weight)
    return q * UNIT - (start - r * UNIT) // weight


class Mixture:
    """Tokens served from each queue at any point of the packed stream, for any number of queues.

    Exact up to 2**62 slots; there are about as many slots as tokens, or UNIT times the tokens of a source without weight.

    Queues of one weight have earned the same at every slot, so what all of them were served follows from their
    totals in order and their running sums. Weights add up to little more than UNIT, so there are at most some
    hundreds of different ones. Queues of one weight begin with credits spread over one token, so that they
    are not all served in the same slot. Within a slot queues are served by weight, then total, then in the order given.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        t = np.array(totals, np.int64)
        w = np.array(totals if weights is None else weights, np.float64)
        w = w / w.sum() if len(w) and w.sum() else w
        w = np.maximum(1, np.round(w * UNIT)).astype(np.int64)
        order = np.lexsort((t, w))
        self.rank = np.empty(len(t), np.int64)  # a queue's place in the order
        self.rank[order] = np.arange(len(t))
        self.totals, self.weights, self.tokens = t[order], w[order], int(t.sum())
        self.each, self.first, self.group = np.unique(self.weights, return_index=True, return_inverse=True)
        self.last = np.append(self.first[1:], len(t))
        self.start = (np.arange(len(t)) - self.first[self.group]) * UNIT // (self.last - self.first)[self.group]
        self.most = int(t.max(initial=0))
        self.keys = self.group * (self.most + 1) + self.totals
        self.sums = np.concatenate([[0], np.cumsum(self.totals)])
        if ((self.totals + 1) / self.weights).max(initial=0) * UNIT > 2.0**62:
            raise ValueError("more than 2**62 slots: a source without weight is too large")
        self.end = int(_slot_of(self.totals + 1, self.weights).max(initial=0))
        self.block = max(1, BLOCK // max(1, len(self.each)))

    def _part(self, group: np.ndarray, slot: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Tokens served up to a slot from the queues of a group that come before ``upto``."""
        first = self.first[group]
        earned, rest = _earned(slot, self.each[group])
        size = self.last[group] - first
        ahead = np.minimum(first - (-(UNIT - rest) * size // UNIT), upto)  # from here on the head start makes one more
        low, high = np.minimum(earned, self.most), np.minimum(earned + 1, self.most)
        base = group * (self.most + 1)
        a = np.minimum(np.searchsorted(self.keys, base + low, side="right"), ahead)
        b = np.clip(np.searchsorted(self.keys, base + high, side="right"), ahead, upto)
        return self.sums[a] - self.sums[first] + (ahead - a) * low + self.sums[b] - self.sums[ahead] + (upto - b) * high

    def groups(self, slot: np.ndarray) -> np.ndarray:
        """[slots, groups + 1]: tokens served up to a slot from all groups before each; the last column is everything."""
        part = self._part(np.arange(len(self.each)), slot[:, None], self.last)
        return np.concatenate([np.zeros((len(slot), 1), np.int64), np.cumsum(part, axis=1)], axis=1)

    def before(self, groups: np.ndarray, row: np.ndarray, slot: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Tokens served up to a slot from the queues before this one; ``groups[row]`` is of the same slots."""
        g = self.group[queue]
        return groups[row, g] + self._part(g, slot, queue)

    def own(self, slot: np.ndarray, queue: np.ndarray) -> np.ndarray:
        return np.minimum(self.totals[queue], _earned(slot, self.weights[queue], self.start[queue])[0])

    def position(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The place in the stream of a token of a queue."""
        out = np.empty(len(token), np.int64)
        for lo in range(0, len(token), self.block):
            q, k = queue[lo : lo + self.block], token[lo : lo + self.block]
            slot = _slot_of(k + 1, self.weights[q], self.start[q])
            row, was, now = np.arange(len(q)), self.groups(slot - 1), self.groups(slot)
            out[lo : lo + self.block] = was[:, -1] + self.before(now, row, slot, q) - self.before(was, row, slot - 1, q) + k - self.own(slot - 1, q)
        return out

    def slots(self, position: np.ndarray) -> np.ndarray:
        """The last slot with no more than ``position`` tokens served."""
        lo, hi = np.zeros(len(position), np.int64), np.full(len(position), self.end, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            ok = self.groups(mid)[:, -1] <= position
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def at(self, position: np.ndarray, index: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the stream's first ``position[index]`` tokens, how many come from a queue and how many from those before it."""
        slot = self.slots(position)
        was, now = self.groups(slot), self.groups(slot + 1)
        left, slot = (position - was[:, -1])[index], slot[index]
        done = self.before(was, index, slot, queue)
        ahead = self.before(now, index, slot + 1, queue) - done
        own = self.own(slot, queue)
        return own + np.clip(left - ahead, 0, self.own(slot + 1, queue) - own), done + np.minimum(left, ahead)


class Windows:
    """Where sequences start: windows, then powers of two for what is left."""

    def __init__(self, tokens: int, window: int):
        self.window, self.full = window, tokens // window
        left, tail = tokens % window, [self.full * window]
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                tail.append(tail[-1] + (1 << bit))
        self.tail = np.array(tail)

    def start(self, sequence: np.ndarray) -> np.ndarray:
        return np.where(sequence <= self.full, sequence * self.window, self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)])

    def holding(self, position: np.ndarray) -> np.ndarray:
        return np.where(position < self.tail[0], position // self.window, self.full + np.searchsorted(self.tail, position, side="right") - 1)


def _tokens(path: str, end: int):
    """(pid, idx, doc_id, queue, n, before, ids): before counts the queue's earlier tokens of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, encode = TaskContext.get().partitionId(), word_encoder(path, end)
        seen: dict[str, int] = {}
        idx = 0
        for b in batches:
            at = 0
            for texts in batches_of([t or "" for t in b.column(1).to_pylist()], 4 << 20):
                ids = encode(texts)
                part = b.slice(at, len(texts))
                at += len(texts)
                before = []
                for q, x in zip(part.column(2).to_pylist(), ids):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), pid, np.int32)), pa.array(np.arange(idx, idx + len(ids))), part.column(0), part.column(2),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array(before, pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()),
                    ],
                    names=["pid", "idx", "doc_id", "queue", "n", "before", "ids"],
                )
                idx += len(ids)

    return run


class WordEncoder:
    """Ids of whole texts by the word vocabulary, ``end`` last.

    The vocabulary lower-cases, drops white space, never merges across runs of letters, single digits and runs of other
    characters, and marks the last token of each. So texts are cut into such runs on their bytes, and what a run
    encodes to is kept in a table; new runs are encoded many at a time and told apart by the marks. A blank-separated part
    with bytes outside ASCII and the Latin letters up to U+024F goes to the library as a whole, and so does
    every text that holds the string of a special token.
    """

    SPACE, LETTER, DIGIT, OTHER, ODD, STOP = range(6)
    TOGETHER = 5_000

    def __init__(self, path: str, end: int, keep: int = 1_500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end, self.table = end, IdTable(keep)
        kind = np.full(256, self.ODD, np.uint8)
        kind[33:127] = self.OTHER
        kind[[9, 10, 13, 32]] = self.SPACE
        kind[48:58] = self.DIGIT
        kind[97:123] = kind[0x80:0xC0] = kind[0xC3:0xCA] = self.LETTER  # bytes are in lower case by then
        self.kind = kind

    def _cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in lower case, start and end of every run, and its kind; a STOP run ends each text."""
        whole = "\n".join(texts).encode() + b"\n"
        data = whole.lower()
        byte = np.frombuffer(data + b"\n\n\n", np.uint8)
        kind = self.kind[byte]
        if not whole.isascii():
            lead = np.flatnonzero((byte == 0xC3) | (byte == 0xC4))
            after = byte[lead + 1]  # multiplication and division signs, and the dotted I, which has two code points in lower case
            kind[lead[np.where(byte[lead] == 0xC3, (after == 0x97) | (after == 0xB7), after == 0xB0)]] = self.ODD
        odd = np.flatnonzero(kind == self.ODD)
        if len(odd):
            space = np.concatenate([[-1], np.flatnonzero(kind == self.SPACE)])
            part = np.unique(np.searchsorted(space, odd))
            step = np.zeros(len(kind) + 1, np.int8)
            step[space[part - 1] + 1] += 1
            step[space[part]] -= 1
            kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = self.ODD
        kind = kind[:-3]
        stop = np.cumsum(np.array([len(t.encode()) + 1 for t in texts] if not whole.isascii() else [len(t) + 1 for t in texts], np.int64)) - 1
        kind[stop] = self.STOP
        start = np.ones(len(kind), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT) | (kind[1:] == self.STOP)
        quote = np.flatnonzero((byte[:-3] == 39) & start & (kind == self.OTHER))
        if len(quote):  # 's 't 'm 'd, 're 've 'll
            one, two = byte[quote + 1], byte[quote + 2]
            short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            for hit, size in ((short, 2), (long, 3)):
                at = quote[hit & (kind[np.minimum(quote + 1, len(kind) - 1)] == self.LETTER)]
                start[at + 1] = False
                then = at + size
                start[then] |= kind[then] == self.LETTER
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(kind))
        runs = kind[begin]
        some = runs != self.SPACE
        return data, begin[some], end[some], runs[some]

    def _learn(self, parts: list[tuple[bytes, np.ndarray]], pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of new runs; a run with odd bytes may be several to the library."""
        text = [parts[p][0][a:b].decode() for p, a, b in pieces]
        plain = [i for i, (p, a, _) in enumerate(pieces) if not parts[p][1][a]]
        odd = [i for i, (p, a, _) in enumerate(pieces) if parts[p][1][a]]
        out: list = [None] * len(text)
        for lo in range(0, len(plain), self.TOGETHER):
            some = plain[lo : lo + self.TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([text[i] for i in some])], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                for i, x in zip(some, np.split(ids, ends[:-1])):
                    out[i] = x
            else:
                odd += some
        for lo in range(0, len(odd), self.TOGETHER):
            some = odd[lo : lo + self.TOGETHER]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([text[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.int32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as 16-bit numbers."""
        special = [i for i, t in enumerate(texts) if "<" in t and any(x in t.lower() for x in self.special)]
        plain = list(texts)
        for i in special:
            plain[i] = ""
        data, start, end, kind = self._cut(plain)
        stop = kind == self.STOP
        odd = np.zeros(len(data), bool)
        odd[start[kind == self.ODD]] = True
        inner = ~stop
        (row,) = rows_of(self.table, [(data, start[inner], end[inner])], lambda pieces: self._learn([(data, odd)], pieces))
        flat, size = self.table.lay(row)
        doc = np.cumsum(stop)[inner]  # stops before the run: its text's number
        n = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
        at = np.cumsum(n + 1)
        ids = np.full(int(at[-1]), self.end, np.uint16)
        keep = np.ones(len(ids), bool)
        keep[at - 1] = False
        ids[keep] = flat
        out = np.split(ids, at[:-1])
        for i in special:
            out[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.end], np.uint16)
        return out


def word_encoder(path: str, end: int) -> WordEncoder:
    """One encoder a worker."""
    if (path, end) not in _encoders:
        _encoders[path, end] = WordEncoder(path, end)
    return _encoders[path, end]


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows, each as often as its size, and the count within the row."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _cuts(mixture: Mixture, windows: Windows, q: np.ndarray, n: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, sequence, from, to, offset) of the pieces of documents; from and to count the queue's tokens."""
    first, last = (windows.holding(mixture.position(q, k)) for k in (begin, begin + n - 1))
    wide = last - first + 1
    some = np.minimum(n, wide)  # what is looked at: sequences, or tokens where they are fewer
    for rows in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(some) // BLOCK)) + 1):
        thin = rows[n[rows] < wide[rows]]
        dense = rows[n[rows] >= wide[rows]]
        r, i = _spread(wide[dense])
        row, sequence = dense[r], first[dense][r] + i
        r, i = _spread(n[thin])
        place = windows.holding(mixture.position(q[thin][r], begin[thin][r] + i))
        new = np.flatnonzero(np.diff(r, prepend=-1) | np.diff(place, prepend=-1))
        row, sequence = np.concatenate([row, thin[r[new]]]), np.concatenate([sequence, place[new]])
        order = np.argsort(sequence, kind="stable")
        row, sequence = row[order], sequence[order]
        found, index = np.unique(sequence, return_inverse=True)
        for a in range(0, len(found), mixture.block):
            lo, hi = np.searchsorted(index, [a, a + mixture.block])
            for x in range(lo, hi, BLOCK):
                part = slice(x, min(x + BLOCK, hi))
                at, inside = np.unique(index[part], return_inverse=True)
                s = row[part]
                own, ahead = mixture.at(windows.start(found[at]), inside, q[s])
                own_end, ahead_end = mixture.at(windows.start(found[at] + 1), inside, q[s])
                f, t = np.maximum(own, begin[s]), np.minimum(own_end, begin[s] + n[s])
                ok = t > f
                yield s[ok], sequence[part][ok], f[ok], t[ok], (ahead_end - ahead + f - own)[ok]


def _pieces(mixture: Mixture, queues: dict[str, int], window: int):
    """Rows (doc_id, queue, n, begin, ids) to the pieces of each document; begin: its place in its queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(mixture.tokens, window)
        for b in batches:
            if not b.num_rows:
                continue
            q = mixture.rank[[queues[x] for x in b.column(1).to_pylist()]]
            n, begin, ids = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4)
            text = [np.frombuffer(x.as_buffer(), "<u2") for x in ids]
            for row, sequence, f, t, offset in _cuts(mixture, windows, q, n, begin):
                start = f - begin[row]
                crc = [zlib.crc32(text[r][x:y].astype("<u4").tobytes()) for r, x, y in zip(row.tolist(), start.tolist(), (t - begin[row]).tolist())]
                at = pa.array(row, pa.int64())
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), long(start), long(t - f), long(crc), b.column(2).take(at), long(sequence), long(offset), b.column(1).take(at)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
                )

    return run


def pack(docs: DataFrame, vocabulary: str, *, window: int = 4096, end: int = 2, weights: dict[str, float] | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """Pieces of every document in sequences of ``window`` tokens, each filled to the mixture's proportions.

    weights: target share of tokens by source; without them the corpus's own shares, which hold to the last
    window. A source without a weight gets a share of nearly nothing and so fills the end. All sequences
    but the last few are full; what is left fills sequences of powers of two, so nothing is padded. Texts are encoded
    as the library does by default, which takes the strings of special tokens in a text for these tokens.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue. A null text is
    an empty one and holds the end token alone; null sources are a queue of their own; repeated and null doc_ids keep
    their rows; other columns are ignored; an empty table gives no rows.

    Token ids are written once (16 bits each) and read once. Only token totals by task and queue are
    gathered across tasks. Every source is a queue of its own, however many there are; the driver and each task
    hold a name and a total for each of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = F.concat(F.lit("s"), F.col("source").cast("string")) if "source" in docs.columns else F.lit("s")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(source, F.lit("null")).alias("queue"))
    schema = "pid int, idx long, doc_id long, queue string, n long, before long, ids binary"
    tokens = scratch.save(rows.mapInArrow(_tokens(vocabulary, end), schema))
    parts = tokens.groupBy("queue", "pid").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.save(parts.select("queue", "pid", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead")))
    totals = sorted((r["queue"], r["n"]) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    share = [float((weights or {}).get(q[1:], 0)) for q, _ in totals] if weights else None
    mixture, queues = Mixture([n for _, n in totals], share), {q: i for i, (q, _) in enumerate(totals)}
    places = parts.select("queue", "pid", "ahead")
    if parts.count() <= broadcast_rows:
        places = F.broadcast(places)
    placed = tokens.join(places, ["queue", "pid"]).select("doc_id", "queue", "n", (F.col("before") + F.col("ahead")).alias("begin"), "ids")
    return placed.mapInArrow(_pieces(mixture, queues, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
