"""Exact similarity join on word-shingle sets by rare-first prefix filtering.

A pair at Jaccard similarity t or more shares a shingle among the first n - ceil(t n) + 1 of each
side under any common order of shingles. The order is rare-first: by a document-frequency count over
the whole corpus, then by hash. Counts are held in a table of fixed size (colliding shingles share a
slot), which changes how selective a prefix is and never which pairs are found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.graph import components
from tessera.llm.scratch import Scratch
from tessera.llm.sets import shingles
from tessera.llm.words import chunks

SLICES = 64
SIGNATURE = 128


def _set_ids(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two 64-bit digests, which together name the set."""
    n = np.bincount(row, minlength=n_rows).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    d1, d2 = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        d1[full] = np.add.reduceat(h * (h >> np.uint64(7) | np.uint64(1)), first[full])
        d2[full] = np.bitwise_xor.reduceat(h * np.uint64(0x9FB21C651E98DF25) + (h >> np.uint64(29)), first[full])
    return n, d1.view(np.int64), d2.view(np.int64)


def _scan_sets(k: int, slots: int):
    """Per document its set's name, size and signature; per task the slots' counts, in compressed slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                row, h = shingles(texts[lo:hi], k)
                np.add.at(counts, (h & np.uint64(slots - 1)).astype(np.int64), 1)
                n, d1, d2 = _set_ids(row, h, hi - lo)
                sig = np.bincount(row * SIGNATURE + (h >> np.uint64(57)).astype(np.int64), minlength=(hi - lo) * SIGNATURE)
                sig = sig.astype("<i4").reshape(hi - lo, SIGNATURE)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo:hi], pa.array(n), pa.array(d1), pa.array(d2), pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "sig", "slice", "counts"],
                )
        if counts.any():
            parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())],
                names=["doc_id", "n", "d1", "d2", "sig", "slice", "counts"],
            )

    return run


def _sum_slices(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up a task's slices; what comes out is at most one row for each slice."""
    total: dict[int, np.ndarray] = {}
    for pdf in pdfs:
        for s, c in zip(pdf["slice"], pdf["counts"]):
            x = np.frombuffer(zlib.decompress(c), "<u4").astype(np.uint64)
            total[s] = total[s] + x if s in total else x
    rows = [(int(s), zlib.compress(np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes(), 1)) for s, x in total.items()]
    yield pd.DataFrame({"slice": np.array([r[0] for r in rows], np.int32), "counts": [r[1] for r in rows]})


def _prefixes(k: int, num: int, den: int, slots: int, table):
    """Prefix postings (token, set, size, position) of a task's distinct sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        done: set = set()
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in chunks(texts):
                row, h = shingles(texts[lo:hi], k)
                n, d1, d2 = _set_ids(row, h, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(n):
                    key = (d1[i], d2[i])
                    if key not in done:
                        fresh[i] = True
                        if len(done) < 200_000:  # beyond, a repeated set is only posted again
                            done.add(key)
                keep = fresh[row]
                row, h = row[keep], h[keep]
                order = np.lexsort((h, counts[(h & np.uint64(slots - 1)).astype(np.int64)], row))
                row, h = row[order], h[order]
                size = np.bincount(row, minlength=hi - lo)
                first = np.cumsum(size) - size
                pos = np.arange(len(row)) - first[row]
                take = pos < (n - (num * n + den - 1) // den + 1)[row]
                row, h, pos = row[take], h[take], pos[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(d1[row]), pa.array(d2[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))],
                    names=["token", "d1", "d2", "n", "pos"],
                )

    return run


def _verify(k: int, num: int, den: int):
    """Rows (a, b, text_a, text_b) to the pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(ta), bool)
            for lo, hi in chunks(ta, tb):
                row, h = shingles([x for pair in zip(ta[lo:hi], tb[lo:hi]) for x in pair], k)
                n = np.bincount(row, minlength=2 * (hi - lo))
                order = np.lexsort((h, row >> 1))
                pair, g = (row >> 1)[order], h[order]
                same = (pair[1:] == pair[:-1]) & (g[1:] == g[:-1])
                shared = np.bincount(pair[1:][same], minlength=hi - lo)
                ok[lo:hi] = (den + num) * shared >= num * (n[0::2] + n[1::2])
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    return run


class JaccardJoin:
    """Components of documents linked at Jaccard similarity num/den or more of their k-word shingle sets.

    ``components(docs)`` returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, itself included). Null and empty texts, and texts of white space only, have an
    empty set and link with nothing. Rows with equal sets are one class; classes are compared, never
    copies. Rows that share a doc_id are one document to the links, also where their texts differ. A null doc_id keeps its row and names no
    component. Other columns are ignored, whatever their names. An empty table gives an empty result.

    Cost: one scan for counts, one for prefixes (a quarter of all shingles, shuffled once by shingle),
    and texts only of classes that share a prefix shingle. Round one tests each class against
    two others under each shingle: that with the fewest rarer shingles, the centre of a group of near copies, and the
    preceding one in that order. So its candidates grow with the postings. Round two
    tests the pairs that lie in different components by then and whose length, positional and suffix
    bounds allow a link. Every pair is verified at most once.
    """

    def __init__(self, k: int = 5, num: int = 3, den: int = 4, slot_bits: int = 21):
        self.k, self.num, self.den, self.slots = k, num, den, 1 << slot_bits

    def classes(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """Of each row its set's name (n, d1, d2) and signature, without a slice; in rows with a slice, counts of the slot table."""
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        schema = "doc_id long, n long, d1 long, d2 long, sig binary, slice int, counts binary"
        return scratch.save(text.mapInArrow(_scan_sets(self.k, self.slots), schema))

    def _frequencies(self, slices: DataFrame) -> np.ndarray:
        """The slot table: 4 bytes a slot, 8 MB by default, whatever the corpus."""
        part = slices.mapInPandas(_sum_slices, "slice int, counts binary")
        part = part.repartition(SLICES, "slice").mapInPandas(_sum_slices, "slice int, counts binary")
        table = np.zeros((SLICES, self.slots // SLICES), np.uint32)
        for r in part.collect():
            table[r["slice"]] += np.frombuffer(zlib.decompress(r["counts"]), "<u4")
        return table.reshape(-1)

    def _bound(self, df: DataFrame, first: bool) -> DataFrame:
        """Length and positional filters on rows of a shared shingle and its places pa and pb.

        Every row of a pair that reaches the threshold passes with ``first`` unset. With it, only rows pass that
        can be the pair's first shared shingle: nothing before it is shared, so what follows must suffice.
        """
        need = (F.lit(self.num) * (F.col("na") + F.col("nb")) + (self.num + self.den - 1)) / F.lit(self.num + self.den)
        most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        most = most if first else most + F.least("pa", "pb")
        fits = F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num
        return df.where(fits & (most >= F.floor(need)))

    def _links(self, pairs: DataFrame, rep: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
        """Suffix filter on signatures, then the exact test, for distinct pairs (a, b) of class numbers."""
        sig = F.pandas_udf(_signature_bound(self.num, self.den), "boolean")
        side = lambda s: rep.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(sig("na", "nb", "sa", "sb")).select("a", "b")
        pairs = scratch.save(pairs.distinct())
        text = lambda s: texts.select(F.col("cls").alias(s), F.col("text").alias(f"t{s}"))
        return scratch.save(
            pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify(self.k, self.num, self.den), "a long, b long").distinct()
        )

    def _same_document(self, rows: DataFrame, rep: DataFrame) -> DataFrame:
        """Edges (a, b) between the classes of rows that share a doc_id."""
        some = rows.where("n > 0 and doc_id is not null")
        again = some.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low != high").select("doc_id")
        own = some.select("doc_id", "d1", "d2").join(again, "doc_id", "left_semi").join(rep.select("d1", "d2", "cls"), ["d1", "d2"])
        least = own.groupBy("doc_id").agg(F.min("cls").alias("a"))
        return own.join(least, "doc_id").select("a", F.col("cls").alias("b")).where("a != b").distinct()

    def components(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id of every row; see the class."""
        spark = docs.sparkSession
        scratch = Scratch(spark, "jaccard")
        both = self.classes(docs, scratch)
        rows, slices = both.where("slice is null").select("doc_id", "n", "d1", "d2", "sig"), both.where("slice is not null").select("slice", "counts")
        table = spark.sparkContext.broadcast(self._frequencies(slices))

        # a class is named by its smallest doc_id, null ids last
        rep = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("cls"), F.min("sig").alias("sig"))
        rep = scratch.save(rep)
        text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
        posts = text.mapInArrow(_prefixes(self.k, self.num, self.den, self.slots, table), "token long, d1 long, d2 long, n int, pos int")
        by = Window.partitionBy("token")
        shared = (
            posts.withColumns({"low": F.min("d1").over(by), "high": F.max("d1").over(by)})
            .where("low < high").select("token", "d1", "d2", "n", "pos").distinct()
        )
        shared = scratch.save(shared.join(rep.where("cls is not null").select("d1", "d2", "cls"), ["d1", "d2"]).select("token", "cls", "n", "pos"))

        order = Window.partitionBy("token").orderBy("pos", "n", "cls")
        me = F.struct("cls", "n", "pos")
        tested = shared.select(me.alias("x"), F.array(F.first(me).over(order), F.lag(me).over(order)).alias("ys"))
        tested = tested.select("x", F.explode("ys").alias("y")).where("y is not null and x.cls != y.cls")
        tested = tested.select(
            F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"),
            F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"),
        )
        tested = scratch.save(self._bound(tested, first=False).select("a", "b").distinct())

        named = scratch.save(rep.join(shared.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "sig"))
        texts = docs.select(F.col("doc_id").cast("long").alias("cls"), F.col("text").cast("string").alias("text")).where("text is not null")
        texts = scratch.save(texts.join(named.select("cls").distinct(), "cls", "left_semi").distinct())

        first = self._links(tested, named, texts, scratch)
        comp = components(first, scratch)
        placed = shared.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        placed = placed.withColumns({"low": F.min("component").over(by), "high": F.max("component").over(by)})
        placed = scratch.save(placed.where("low < high").select("token", "cls", "n", "pos", "component"))
        x = placed.select("token", F.col("cls").alias("xa"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
        y = placed.select("token", F.col("cls").alias("xb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
        rest = self._bound(x.join(y, "token").where("ca < cb"), first=True)
        rest = rest.select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b")).distinct()
        rest = scratch.save(rest.join(tested, ["a", "b"], "left_anti"))
        second = self._links(rest, named, texts, scratch)

        edges = first.unionByName(second).unionByName(self._same_document(rows, rep))
        final = components(edges, scratch).select(F.col("node").alias("cls"), "component")
        placed = rep.join(final, "cls", "left").select("d1", "d2", F.coalesce("component", "cls").alias("component"))
        placed = scratch.save(placed)
        scratch.keep(both, placed)
        some = rows.where("n > 0").join(placed, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return some.unionByName(none)


def _signature_bound(num: int, den: int):
    def fits(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        if not len(na):
            return pd.Series([], dtype=bool)
        a = np.frombuffer(b"".join(sa), "<i4").reshape(-1, SIGNATURE)
        b = np.frombuffer(b"".join(sb), "<i4").reshape(-1, SIGNATURE)
        return pd.Series((num + den) * np.minimum(a, b).sum(axis=1) >= num * (na + nb).to_numpy())

    return fits
