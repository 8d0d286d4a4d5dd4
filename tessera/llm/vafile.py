"""Exact top-k inner products by vector-approximation files.

The file keeps one cell number a component, one byte, in blocks of some thousand vectors with the cells' bounds. A scan
of it bounds every score from both sides. What cannot be among the best by these bounds is done with; the exact
vectors of the rest are fetched by falling upper bound until the k-th result is certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.scratch import Scratch
from tessera.llm.vectors import matrix

BLOCK = 1 << 20  #: components in a block of cells, at most
TILE = 1 << 21  #: scores that are bounded at once
_VECTORS = "uid long, vec_id long, dim int, v array<double>"
_CELLS = "p long, dim int, uids binary, cells binary, low binary, step binary"
_QUERIES = "dim int, q int, uids binary, v binary"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, dim, v) with v the floor of scale times each component, as whole doubles, of the rows that take part.

    Null and empty vectors, null ids, and vectors with null or non-finite components, also after scaling, take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                if i is not None and x.is_valid and len(x) and not x.values.null_count:
                    with np.errstate(over="ignore"):
                        v = np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                    if np.isfinite(v).all():
                        rows.append((i, v))
            n = [len(v) for _, v in rows]
            flat = pa.array(np.concatenate([np.zeros(0), *(v for _, v in rows)]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(rows))), pa.array([i for i, _ in rows], pa.int64()), pa.array(n, pa.int32()), lists], names=["uid", "vec_id", "dim", "v"])
            uid += len(rows)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return Scratch(vectors.sparkSession, "vafile").save(rows.mapInArrow(run, _VECTORS))


def _blocks(batches: Iterator[pa.RecordBatch], most) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, uids, vectors) of each task's rows, at most ``most(dim)`` together."""
    held: dict[int, list] = {}
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == d))
            held.setdefault(d, []).append((part.column("uid").to_numpy(), matrix(part.column("v"))))
            while sum(len(u) for u, _ in held[d]) >= most(d):
                u, x = (np.concatenate(c) for c in zip(*held[d]))
                yield d, u[: most(d)], x[: most(d)]
                held[d] = [(u[most(d) :], x[most(d) :])]
    for d, parts in held.items():
        u, x = (np.concatenate(c) for c in zip(*parts))
        if len(u):
            yield d, u, x


def cells_of(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers, one byte each, the least value and the width of a cell of each component."""
    low = x.min(axis=0)
    step = np.maximum((x.max(axis=0) / 2 - low / 2) / (1 << bits) * 2, 1e-9)
    return np.clip(np.floor((x - low) / step), 0, (1 << bits) - 1).astype(np.uint8), low, step


def _file(bits: int):
    """Rows of blocks of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, uids, x in _blocks(batches, lambda d: max(1, BLOCK // d)):
            order = np.argsort(uids)
            uids, x = uids[order], x[order]
            cells, low, step = cells_of(x, bits)
            raw = [pa.array([c.tobytes()], pa.binary()) for c in (uids.astype("<i8"), cells, low, step)]
            yield pa.RecordBatch.from_arrays([pa.array([int(uids[0])], pa.int64()), pa.array([d], pa.int32()), *raw], names=["p", "dim", "uids", "cells", "low", "step"])

    return run


def bounds(cells: np.ndarray, low: np.ndarray, step: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the cells' middles, [queries, vectors], and how far each query's exact scores can lie from them."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (q @ (low + step / 2))[:, None] + (q * step) @ cells.T.astype(np.float64)
        size = np.abs(q) @ (np.abs(low) + step * 256)
        spread = np.abs(q) @ step + size * 1e-12 + 1e-6  # half of it by the cells, the rest for borders and rounding
    return middle, spread


def _scan(k: int):
    """Block pairs to (quid, uid, low, high) of what may be among a query's k best of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d = r["dim"]
                uids, quids = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["quids"], "<i8")
                cells, qs = np.frombuffer(r["cells"], np.uint8).reshape(-1, d), np.frombuffer(r["qv"], "<f8").reshape(-1, d)
                low, step = np.frombuffer(r["low"], "<f8"), np.frombuffer(r["step"], "<f8")
                for lo in range(0, len(qs), 256):
                    yield _candidates(k, uids, cells, low, step, quids[lo : lo + 256], qs[lo : lo + 256])

    return run


def _candidates(k: int, uids, cells, low, step, quids, q) -> pa.RecordBatch:
    sure, found = np.full(len(q), -np.inf), []
    best = np.full((len(q), k), -np.inf)  # the k largest lower bounds so far
    tile = max(1, TILE // max(1, len(q)))
    for at in range(0, len(uids), tile):
        middle, spread = bounds(cells[at : at + tile], low, step, q)
        lower, upper = middle - spread[:, None], middle + spread[:, None]
        odd = ~(np.isfinite(lower) & np.isfinite(upper))
        lower[odd], upper[odd] = -np.inf, np.inf
        own = np.flatnonzero(np.isin(quids, uids[at : at + tile]))
        place = np.searchsorted(uids[at : at + tile], quids[own])
        lower[own, place] = upper[own, place] = -np.inf  # a query's own row
        both = np.concatenate([best, lower], axis=1)
        best = -np.partition(-both, k - 1, axis=1)[:, :k]
        sure = best.min(axis=1)
        i, j = np.nonzero((upper >= sure[:, None]) & (upper > -np.inf))
        found.append((i, j + at, lower[i, j], upper[i, j]))
    i, j, lower, upper = (np.concatenate(c) for c in zip(*found))
    keep = upper >= sure[i]
    return pa.RecordBatch.from_arrays([pa.array(quids[i[keep]]), pa.array(uids[j[keep]]), pa.array(lower[keep]), pa.array(upper[keep])], names=["quid", "uid", "low", "high"])


def _sortable(n: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    size = (abs(n).bit_length() + 7) // 8
    plain = size.to_bytes(2, "big") + abs(n).to_bytes(size, "big")
    return b"\1" + plain if n >= 0 else b"\0" + bytes(255 - c for c in plain)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (quid, uid, high, x, y) to the exact score, null beyond 64 bits, with its order and its value as a double."""
    for b in batches:
        scores = []
        for x, y in zip(b.column(3), b.column(4)):
            p, q = x.values.to_numpy(), y.values.to_numpy()
            if np.abs(p).max() * np.abs(q).max() * len(p) < 2.0**53:
                scores.append(int(p @ q))
            else:  # whole numbers of any size
                scores.append(sum(int(s) * int(t) for s, t in zip(p, q)))
        fits = [s if -(1 << 63) <= s < 1 << 63 else None for s in scores]
        near = [float(s) if abs(s) < 1 << 1000 else math.copysign(math.inf, s) for s in scores]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(fits, pa.int64()), pa.array([_sortable(s) for s in scores], pa.binary()), pa.array(near)], names=["quid", "uid", "high", "score", "place", "near"])


class VAFile:
    """The vectors of (uid, vec_id, dim, v) with their file of cells, both written once.

    ``bits`` a component, at most 8. Cells take a byte a component where vectors take eight. Of equal vectors the k + 1
    with the smallest ids are filed: no other can be among a query's k best, as these score the same. So a crowd of
    copies, however large, is a few rows to each query.
    """

    def __init__(self, vectors: DataFrame, k: int, bits: int = 8):
        self.scratch = Scratch(vectors.sparkSession, "vafile")
        self.vectors, self.k = vectors, k
        copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "uid"))
        filed = vectors.withColumn("copy", copy).where(F.col("copy") <= k + 1)
        self.cells = self.scratch.save(filed.select("uid", "dim", "v").mapInArrow(_file(min(bits, 8)), _CELLS))

    def candidates(self, queries: DataFrame, query_block: int = 4_000) -> DataFrame:
        """(quid, uid, high): the rows whose upper bound reaches the k-th best lower bound of all of a query.

        Blocks of cells meet blocks of queries, both of bounded size; a pair returns little more than k rows a query.
        """
        k = self.k
        rounds = max(1, -(-queries.count() // query_block))
        parts = max(1, self.cells.count())
        spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                which = b.column("q").to_numpy()
                for q in np.unique(which).tolist():
                    for d, uids, x in _blocks(iter([b.filter(pa.array(which == q))]), lambda d: max(1, BLOCK // 8 // d)):
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([q], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (uids.astype("<i8"), x))], names=["dim", "q", "uids", "v"])

        asked = queries.select("uid", "dim", "v", spread("uid", rounds).alias("q")).repartition("dim", "q").mapInArrow(pack, _QUERIES)
        asked = asked.select("dim", "q", F.col("uids").alias("quids"), F.col("v").alias("qv"), every(parts).alias("p"))
        cells = self.cells.withColumns({"p": spread("p", parts), "q": every(rounds)})
        found = cells.join(asked, ["dim", "p", "q"]).select("dim", "uids", "cells", "low", "step", "quids", "qv").mapInArrow(_scan(k), "quid long, uid long, low double, high double")
        found = self.scratch.save(found)
        at = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("low")))
        sure = found.select("quid", "low", at.alias("r")).where(F.col("r") <= k).groupBy("quid").agg(F.min("low").alias("sure"), F.count("*").alias("n"))
        sure = sure.select("quid", F.when(F.col("n") == k, F.col("sure")).otherwise(float("-inf")).alias("sure"))
        return found.join(sure, "quid").where(F.col("high") >= F.col("sure")).select("quid", "uid", "high")

    def top(self, queries: DataFrame, *, query_block: int = 4_000) -> DataFrame:
        """query_id, rank, vec_id, score: see ``top_k``."""
        k = self.k
        order = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("high"), "uid"))
        left = self.scratch.save(self.candidates(queries, query_block).withColumn("turn", order))
        asked = queries.select(F.col("uid").alias("quid"), F.col("v").alias("y"))

        def read(rows: DataFrame) -> DataFrame:
            both = rows.join(self.vectors.select("uid", F.col("v").alias("x")), "uid").join(asked, "quid").select("quid", "uid", "high", "x", "y")
            return self.scratch.save(both.mapInArrow(_exact, "quid long, uid long, high double, score long, place binary, near double"))

        first = read(left.where(F.col("turn") <= 2 * k))
        at = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("place")))
        kth = first.select("quid", "near", at.alias("r")).where(F.col("r") == k).select("quid", (F.col("near") - F.abs("near") * 1e-12).alias("kth"))
        # what could still be better than the k-th result; bounds have slack for rounding
        rest = left.where(F.col("turn") > 2 * k).join(kth, "quid", "left").where(F.col("kth").isNull() | F.col("kth").isin(math.inf, -math.inf) | (F.col("high") >= F.col("kth")))
        found = first.unionByName(read(rest.select("quid", "uid", "high")))
        name = self.vectors.select("uid", "vec_id")
        found = found.join(name, "uid").join(queries.select(F.col("uid").alias("quid"), F.col("vec_id").alias("query_id")), "quid")
        rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("place"), "vec_id", "uid"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, bits: int = 8, query_block: int = 4_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by integer inner product, ties to the smaller id.

    vectors: (uid, vec_id, dim, v) of whole doubles, as ``quantised`` gives; queries: rows of it. A query's own row is no
    result of it, repeats of it are. Only vectors of a query's length are compared. Queries with fewer rows to choose
    from get all; an empty table gives none. Scores and their order are exact at any size; one that does not fit
    64 bits is null in ``score``.
    """
    return VAFile(vectors, k, bits).top(queries, query_block=query_block)
