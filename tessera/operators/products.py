"""Products of vectors over pairs of a batch, block by block: numpy inside tasks, cells of two blocks dealt out by Spark.

A vector is a row (batch, doc, at array<long>, weight array<double>): the weights at its places; places that two vectors
share are multiplied. A batch's documents are in few blocks; a task gets the vectors of a cell's two blocks and multiplies
them tile by tile, so a large batch is many cells and no row of a pair is made before its product is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.scratch import Scratch

WAYS = 6  #: blocks of a batch, as long as they hold no more than HELD numbers and ROWS rows
HELD = 6_000_000
ROWS = 200_000
FILLED = 12_000_000  #: numbers of the filled side of a tile
DENSE = 8  #: vectors with more than one of so many places are multiplied as dense ones


def sparse(vectors: DataFrame) -> DataFrame:
    """Packs rows (batch, doc, term, weight); terms are told apart by 64-bit hashes."""
    rows = vectors.groupBy("batch", "doc").agg(F.collect_list(F.struct(F.xxhash64("term").alias("at"), F.col("weight").cast("double").alias("weight"))).alias("v"))
    return rows.select("batch", "doc", F.col("v.at").alias("at"), F.col("v.weight").alias("weight"))


def dense(vectors: DataFrame) -> DataFrame:
    """Packs unit vectors of (batch, doc, embedding). Null vectors, and such with null or non-finite components or no length, have no weights;
    vectors of unequal length share no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            size = pc.fill_null(v.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = v.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            row = np.repeat(np.arange(len(size)), size)
            top = np.zeros(len(size))
            np.fmax.at(top, row, np.abs(x))
            good = (top > 0) & (np.bincount(row, ~np.isfinite(x), len(size)) == 0)
            keep = good[row]
            place = (np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size))[keep]
            row, x = row[keep], x[keep] / top[row[keep]]  # so that no square overflows
            norm = np.sqrt(np.bincount(row, x * x, len(size)))
            cut = pa.array(np.concatenate([[0], np.cumsum(np.where(good, size, 0))]), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(c)) for c in (place + (size[row] << 32), x / norm[row])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["batch", "doc", "at", "weight"])

    kinds = dict(vectors.dtypes)
    rows = vectors.select("batch", "doc", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"batch {kinds['batch']}, doc {kinds['doc']}, at array<long>, weight array<double>")


def _block(doc: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(doc), blocks).cast("int")


def _blocks(packed: DataFrame, block: int) -> DataFrame:
    return packed.groupBy("batch").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, place and weight of every number of the packed rows."""
    at, weight = (rows[c].combine_chunks() for c in ("at", "weight"))
    size = at.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), at.flatten().to_numpy(), weight.flatten().to_numpy()


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, after how many that is."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked_numbers(x: bytes) -> np.ndarray:
    out = np.zeros(((len(x) - 1) // x[0], 8), np.uint8)
    out[:, : x[0]] = np.frombuffer(x, np.uint8, offset=1).reshape(-1, x[0])
    return out.view("<u8").ravel()


def tight(at: np.ndarray, tf: np.ndarray, norm: float) -> tuple[bytes, bytes]:
    """A vector of counts as bytes: its places by their differences, and its length with its counts. Its weights are (1 + log(tf)) * scale / norm with the scale of each place, which a cell gets once."""
    order = np.argsort(at)
    return packed_numbers(np.diff(at[order], prepend=0)), np.float64(norm).tobytes() + packed_numbers(tf[order])


def _loose(at: pa.Array, weight: pa.Array, scale: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """The places and weights of ``tight`` vectors; of empty bytes none."""
    places = [np.cumsum(unpacked_numbers(x)).astype(np.int64) if x else np.empty(0, np.int64) for x in at.to_pylist()]
    found = [(1 + np.log(unpacked_numbers(x[8:]))) * scale[p] / np.frombuffer(x[:8])[0] if x else np.empty(0) for x, p in zip(weight.to_pylist(), places)]
    cut = pa.array(np.concatenate([[0], np.cumsum(list(map(len, places)))]), pa.int64())
    return tuple(pa.LargeListArray.from_arrays(cut, pa.array(np.concatenate([np.empty(0, t), *x]))) for x, t in ((places, np.int64), (found, np.float64)))


class Vectors:
    """The vectors of a cell's rows, one after the other."""

    def __init__(self, at: pa.ListArray, weight: pa.ListArray):
        self.cut = np.concatenate([[0], np.cumsum(pc.fill_null(at.value_lengths(), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.at, self.weight = at.flatten().to_numpy(), weight.flatten().to_numpy()

    def left(self, lo: int, hi: int, ones: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The places that some rows have, and a line for each place: the weights of these rows, or ones for them."""
        part = slice(self.cut[lo], self.cut[hi])
        places, at = np.unique(self.at[part], return_inverse=True)
        own = np.zeros((len(places), hi - lo))
        own[at, np.repeat(np.arange(hi - lo), np.diff(self.cut[lo : hi + 1]))] = 1.0 if ones else self.weight[part]
        return places, own

    def products(self, left: tuple[np.ndarray, np.ndarray], lo: int, hi: int, ones: bool = False) -> np.ndarray:
        """The product of each of the left rows with each of these. Only places that both sides have are multiplied."""
        places, own = left
        out = np.zeros((hi - lo, own.shape[1]))
        part = slice(self.cut[lo], self.cut[hi])
        if not len(places) or part.start == part.stop:
            return out.T
        at = np.searchsorted(places, self.at[part])
        at[at == len(places)] = 0
        both = np.flatnonzero(places[at] == self.at[part])
        row, at = np.repeat(np.arange(hi - lo), np.diff(self.cut[lo : hi + 1]))[both], at[both]
        weight = np.ones(len(both)) if ones else self.weight[part][both]
        if DENSE * len(both) > len(out) * len(places):
            full = np.zeros((hi - lo, len(places)))
            full[row, at] = weight
            return (full @ own).T
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        for r in np.unique(row):
            x = slice(cut[r], cut[r + 1])
            out[r] = weight[x] @ own[at[x]]
        return out.T

    def bounds(self, lo: int, hi: int, block: int, unit: int = 1) -> Iterator[tuple[int, int]]:
        """The rows from lo to hi by ``block``, fewer, but whole units, where their lines would be more than FILLED numbers."""
        while lo < hi:
            top = min(lo + block, hi)
            while top - lo > unit and (self.cut[top] - self.cut[lo]) * (top - lo) > FILLED and len(np.unique(self.at[self.cut[lo] : self.cut[top]])) * (top - lo) > FILLED:
                top = lo + max(unit, (top - lo) // 2 // unit * unit)
            yield lo, top
            lo = top


def _by_cell(packed: DataFrame, block: int, place: Column | None = None, scales: DataFrame | None = None):
    """The vectors of each batch by cells of two of its blocks, those by hash or, with ``place`` (from 0 to below 1), in its order.

    A batch has at most WAYS blocks until these hold more than HELD numbers each, so vectors are shuffled a fixed number of times, however large a batch is. ``scales`` (batch, scale array<double>) go to each
    cell as a row whose block is -1, with the scales' bytes in the place of the one ``tight`` vector's weights.
    """
    packed = Scratch(packed.sparkSession, "vectors").save(packed)
    flat = lambda c, t: F.flatten(c) if t.startswith("array<array") else F.col(c)
    held = sum((F.greatest(F.size(flat(c, t)), F.lit(0)) for c, t in packed.dtypes if t.startswith("array")), F.lit(0)).cast("long")
    held = sum((2 * F.octet_length(c) for c, t in packed.dtypes if t == "binary" and c.startswith("weight")), held)
    some = F.least(F.ceil(F.count("*") / block), F.lit(WAYS))
    blocks = packed.groupBy("batch").agg(F.greatest(some, F.ceil(F.sum(held) / HELD), F.ceil(F.count("*") / ROWS)).cast("int").alias("blocks"))
    own = _block("doc", "blocks") if place is None else F.floor(place * F.col("blocks")).cast("int")
    rows = packed.join(F.broadcast(blocks), "batch").withColumn("block", own)
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*packed.columns, "block", F.least("block", "to").alias("bi"), F.greatest("block", "to").alias("bj"))
    if scales is not None:
        name = next(c for c, t in packed.dtypes if t == "binary" and c.startswith("weight"))
        one = scales.join(F.broadcast(blocks), "batch").withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        one = one.withColumn("bj", F.explode(F.sequence("bi", F.col("blocks") - 1)))
        none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
        rows = rows.unionByName(one.select("batch", *(F.col("scale").alias(f.name) if f.name == name else none(f) for f in packed.schema if f.name != "batch"), F.lit(-1).alias("block"), "bi", "bj"))
    return rows.groupBy("batch", "bi", "bj")


def _tiles(run, schema: pa.Schema, kinds: list[str], block: int, order: str, unit: int):
    """For a cell: what ``run`` gives for each tile of its rows, from the rows, the two ranges, which of their pairs count (each once) and the products by ``kinds``.

    A tile has ``block`` rows on a side, so memory is that of the cell's vectors and of one tile.
    """

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.sort_by([("block", "ascending"), (order, "ascending")]).combine_chunks()
        if rows["block"][0].as_py() < 0:
            name = next(k for k in kinds if pa.types.is_binary(rows.schema.field("weight" + k).type))
            scale, rows = np.frombuffer(rows["weight" + name][0].as_py()), rows.slice(1).combine_chunks()
            for c, x in zip(("at", "weight"), _loose(*(rows[c + name].combine_chunks() for c in ("at", "weight")), scale)):
                rows = rows.set_column(rows.column_names.index(c + name), c + name, x)
        own, by = rows["block"].to_numpy(), rows[order].to_numpy()
        same = key[1].as_py() == key[2].as_py()
        start = 0 if same else int(np.searchsorted(own, key[2].as_py()))
        sets = {k: Vectors(*(rows[c + k].combine_chunks() for c in ("at", "weight"))) for k in kinds}
        first = sets[max(kinds, key=lambda k: sets[k].cut[-1])]
        right = [(lo, min(lo + block, len(own))) for lo in range(start, len(own), block)]
        for lo, hi in first.bounds(0, len(own) if same else start, block, unit):
            filled: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}

            def product(r: tuple[int, int], kind: str = "", ones: tuple[bool, bool] = (False, False)) -> np.ndarray:
                if (kind, ones[0]) not in filled:
                    filled[kind, ones[0]] = sets[kind].left(lo, hi, ones[0])  # noqa: B023
                return sets[kind].products(filled[kind, ones[0]], *r, ones[1])  # noqa: B023

            for r in right:
                if same and r[1] <= lo:
                    continue
                ok = by[lo:hi][:, None] < by[slice(*r)][None] if same else np.ones((hi - lo, r[1] - r[0]), bool)
                found = run(rows, (lo, hi), r, ok, product)
                if found is not None and len(next(iter(found.values()))):
                    n = len(next(iter(found.values())))
                    yield pa.RecordBatch.from_arrays([pa.repeat(key[0], n), *(pa.array(v) for v in found.values())], schema=pa.schema([pa.field("batch", key[0].type), *schema]))

    return cell


def in_tiles(packed: DataFrame, run, schema: str, *, kinds: tuple[str, ...] = ("",), block: int = 512, place: Column | None = None, order: str = "doc", unit: int = 1, scales: DataFrame | None = None) -> DataFrame:
    """(batch, ...) of what ``run(rows, left, right, ok, product)`` gives, as arrays by name, for each tile of two ranges of a batch's rows; no pair is shuffled.

    packed: (batch, doc, at, weight) and what else ``run`` reads, with more vectors as at_x, weight_x for ``kinds`` such as "_x". ``product(right, kind, ones)`` is the tile's products,
    with ones for either side's weights where asked. One kind may be ``tight`` vectors, with their ``scales`` (batch, scale). Each pair of a batch is in one tile, once where ``ok``. Rows stand by ``order``, blocks are by hash or by ``place``, and a tile begins at a whole ``unit`` of its block's rows.
    """
    names = StructType.fromDDL(schema)
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in names]
    return _by_cell(packed, block, place, scales).applyInArrow(_tiles(run, fields, list(kinds), block, order, unit), f"batch {dict(packed.dtypes)['batch']}, {schema}")


def all_pairs(packed: DataFrame, least: float | None = 0.0, *, block: int = 512, scales: DataFrame | None = None) -> DataFrame:
    """(batch, a, b, value) of the pairs a < b of each batch whose product is at least ``least``, or above it where that is 0, or of all with None. Exact. Documents are numbers,
    one row each; what else they have, such as n, comes as na and nb."""
    kinds = dict(packed.dtypes)
    more = [c for c in packed.columns if c not in ("batch", "doc", "at", "weight")]

    def run(rows: pa.Table, left: tuple[int, int], right: tuple[int, int], ok: np.ndarray, product) -> dict:
        value = product(right)
        i, j = np.nonzero(ok if least is None else ok & (value >= least if least > 0 else value > 0))
        x, y = i + left[0], j + right[0]
        doc = rows["doc"].to_numpy()
        flip = doc[x] > doc[y]
        a, b = np.where(flip, y, x), np.where(flip, x, y)
        sides = {f"{c}{s}": rows[c].to_numpy()[k] for c in more for s, k in (("a", a), ("b", b))}
        return {"a": doc[a], "b": doc[b], "value": value[i, j]} | sides

    columns = "".join(f", {c}{s} {kinds[c]}" for c in more for s in "ab")
    return in_tiles(packed, run, f"a {kinds['doc']}, b {kinds['doc']}, value double{columns}", block=block, scales=scales)


def greatest(packed: DataFrame, *, block: int = 512, scales: DataFrame | None = None) -> DataFrame:
    """(batch, doc, value): the greatest product above 0 of each document with another of its batch. Exact; a tile gives a row a document and none a pair."""
    kinds = dict(packed.dtypes)

    def run(rows: pa.Table, left: tuple[int, int], right: tuple[int, int], ok: np.ndarray, product) -> dict:
        value = np.where(ok, product(right), 0.0)
        top = np.concatenate([value.max(1), value.max(0)])
        at = np.concatenate([np.arange(*left), np.arange(*right)])
        return {"doc": rows["doc"].to_numpy()[at[top > 0]], "value": top[top > 0]}

    found = in_tiles(packed.select("batch", "doc", "at", "weight"), run, f"doc {kinds['doc']}, value double", block=block, scales=scales)
    return found.groupBy("batch", "doc").agg(F.max("value").alias("value"))


def given(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """A cell's pairs with the product of their packed rows as value, without their blocks."""
    doc, order = np.unique(rows["doc"].to_numpy(), return_index=True)
    row, at, weight = _flat(rows)
    places, at = np.unique(at, return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows.num_rows))])
    own = np.zeros(len(places))
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    value, filled = np.zeros(len(a)), None
    place = lambda x: order[np.minimum(np.searchsorted(doc, x), len(doc) - 1)] if len(doc) else None
    there = np.isin(a, doc) & np.isin(b, doc)
    pa_, pb_ = (place(a), place(b)) if len(doc) else (a, b)
    for k in np.lexsort((b, a)):
        if not there[k]:
            continue
        x, y = slice(cut[pa_[k]], cut[pa_[k] + 1]), slice(cut[pb_[k]], cut[pb_[k] + 1])
        if filled != x:
            if filled is not None:
                own[at[filled]] = 0
            own[at[x]], filled = weight[x], x
        value[k] = own[at[y]] @ weight[y]
    return pairs.drop_columns(["ca", "cb"]).append_column("value", pa.array(value))


def cells(pairs: DataFrame, packed: DataFrame, block: int = 256) -> DataFrame:
    """(batch, a, b, ..., ca, cb): the pairs, with what else they have, and the blocks of their two sides."""
    p = pairs.join(_blocks(packed, block), "batch", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return p.select(*pairs.columns, _block("a", "blocks").alias("ca"), _block("b", "blocks").alias("cb"))


def in_cells(packed: DataFrame, pairs: DataFrame, run, columns: str, block: int) -> DataFrame:
    """The pairs with the ``columns`` that ``run`` gives for each cell of pairs and the rows of ``packed`` that it needs, once each."""
    p = cells(pairs, packed, block)
    need = p.select("batch", "ca", "cb", F.explode(F.array("a", "b")).alias("doc")).distinct()
    more = [c for c in packed.columns if c not in ("batch", "doc")]
    rows = need.join(packed, ["batch", "doc"]).select(F.col("batch").alias("own"), F.col("ca").alias("x"), F.col("cb").alias("y"), "doc", *more)
    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return p.groupBy("batch", "ca", "cb").cogroup(rows.groupBy("own", "x", "y")).applyInArrow(run, f"{kinds}, {columns}")


def of_pairs(packed: DataFrame, pairs: DataFrame, *, block: int = 256) -> DataFrame:
    """(batch, a, b, ..., value) of the given pairs, with what else they have; 0 where a vector is missing. A vector goes to the cells where it has pairs, once each."""
    return in_cells(Scratch(packed.sparkSession, "vectors").save(packed), pairs, given, "value double", block)


def _fitted(most: int):
    """For pairs of a cell and their texts' terms: the product of the two vectors of a corpus that is the pair alone; null where no kept term is in both."""
    alone = math.log(3 / 2) + 1  # the weight of a term that one of two texts has; of both it is 1

    def value(x: tuple, y: tuple, own: np.ndarray, times: np.ndarray, other: np.ndarray) -> float | None:
        (ax, tx, lx), (ay, ty, ly) = x, y
        there = own[ay]
        both = there > 0
        if len(ax) + len(ay) - np.count_nonzero(both) > most:  # the most frequent terms of the pair, ties by term
            other[ay] = ty
            kx, ky = ((t + o) * -len(own) + at for at, t, o in ((ax, tx, other[ax]), (ay, ty, times[ay])))
            other[ay] = 0
            last = np.partition(np.concatenate([kx, ky[~both]]), most - 1)[most - 1]
            lx, ly, there, both = lx[kx <= last], ly[ky <= last], there[ky <= last], both[ky <= last]
        if not both.any():
            return None
        p, q = there[both], ly[both]
        norm = lambda whole, shared: alone * alone * max(whole @ whole - shared @ shared, 0.0) + shared @ shared
        return float(p @ q / math.sqrt(norm(lx, p) * norm(ly, q)))

    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        term, tf = (rows[c].combine_chunks() for c in ("term", "tf"))
        cut = np.concatenate([[0], np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = term.flatten().dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))  # by bytes, as the terms are ordered
        at, n = rank[coded.indices.to_numpy()] if len(rank) else np.empty(0, np.int64), tf.flatten().to_numpy()
        log = 1 + np.log(n)
        side = {d: (at[lo:hi], n[lo:hi], log[lo:hi]) for d, lo, hi in zip(rows["doc"].to_pylist(), cut, cut[1:])}
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        own, times, other = np.zeros(len(rank)), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        filled, out = None, [None] * len(a)
        for k in sorted(range(len(a)), key=a.__getitem__):
            if a[k] not in side or b[k] not in side:
                continue
            x = side[a[k]]
            if filled is not x:
                if filled is not None:
                    own[filled[0]] = times[filled[0]] = 0
                own[x[0]], times[x[0]], filled = x[2], x[1], x
            out[k] = value(x, side[b[k]], own, times, other)
        return pairs.drop_columns(["ca", "cb"]).append_column("tfidf", pa.array(out, pa.float64()))

    return run


def fitted_to_pairs(counts: DataFrame, pairs: DataFrame, most: int, *, block: int = 1024) -> DataFrame:
    """(batch, a, b, ..., tfidf) of the given pairs by vectors that are fitted for each pair alone, of its ``most`` most frequent terms; counts: (batch, doc, term array<string>, tf array<long>).

    Each of two texts' weights follows from its own counts and from which terms both have, so no text is repeated for each of its pairs. Pairs without a common term have no row.
    """
    return in_cells(Scratch(counts.sparkSession, "counts").save(counts), pairs, _fitted(most), "tfidf double", block).where("tfidf is not null")


def _grid(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    doc, block = docs["doc"].to_numpy(), docs["block"].to_numpy()
    bi, bj = docs["bi"][0].as_py() if len(doc) else 0, docs["bj"][0].as_py() if len(doc) else 0
    left, right = (np.flatnonzero(block == b) for b in (bi, bj))
    score = np.zeros((len(left), len(right)))
    place = np.zeros(len(doc), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    there = np.isin(a, doc) & np.isin(b, doc)
    order = np.argsort(doc)
    x, y = (order[np.searchsorted(doc[order], side[there])] for side in (a, b))
    x, y = np.where(block[x] == bi, x, y), np.where(block[x] == bi, y, x)
    score[place[x], place[y]] = pairs["score"].to_numpy()[there]
    ways = [(left, right, score)]
    if bi == bj:
        score[place[y], place[x]] = pairs["score"].to_numpy()[there]
        np.fill_diagonal(score, 1.0)
    else:
        ways.append((right, left, score.T))
    name = docs["label"].combine_chunks()
    out = [pa.table({"batch": docs["batch"].combine_chunks().take(pa.array(np.repeat(r, len(c)))), "row_label": name.take(pa.array(np.repeat(r, len(c)))), "col_label": name.take(pa.array(np.tile(c, len(r)))), "score": pa.array(s.ravel())}) for r, c, s in ways]
    return pa.concat_tables(out)


def grid(docs: DataFrame, pairs: DataFrame, *, block: int = 512) -> DataFrame:
    """(batch, row_label, col_label, score) of every ordered pair of a batch's documents (batch, doc, label): 1 with itself, the score of pairs (batch, a, b, score), 0 where there is none.

    Cells of two blocks are filled where they are, so neither the grid is shuffled nor a batch one group."""
    rows = docs.join(_blocks(docs, block), "batch").withColumn("block", _block("doc", "blocks")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("batch", F.least("block", "to").alias("bi"), F.greatest("block", "to").alias("bj"), "block", "doc", "label")
    given = cells(pairs, docs, block).select(F.col("batch").alias("own"), F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), "a", "b", "score")
    kinds = dict(docs.dtypes)
    found = rows.groupBy("batch", "bi", "bj").cogroup(given.groupBy("own", "x", "y"))
    return found.applyInArrow(_grid, f"batch {kinds['batch']}, row_label {kinds['label']}, col_label {kinds['label']}, score double")
