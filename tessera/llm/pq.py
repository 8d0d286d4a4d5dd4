"""Near-duplicate vectors by product quantisation.

Unit vectors are filed under their nearest coarse centre; residuals are coded by subspace. A query visits
every list that could hold a neighbour, ranks its vectors by table-lookup distances, and computes exact
cosines for those whose distance, less their own coding error, is within the radius. Probes and table
distances are bounds, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.scratch import Scratch
from tessera.llm.vectors import kmeans, matrix, nearest, sample, usable

_SLACK = 1e-7


@dataclass
class Codebook:
    centre: np.ndarray  # coarse centres
    books: list[np.ndarray]  # by subspace
    cuts: list[tuple[int, int]]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, codes: int) -> Codebook:
        if not len(x):
            return cls(np.zeros((1, 1)), [np.zeros((1, 1))], [(0, 1)])
        centre = kmeans(x, lists)
        rest = x - centre[nearest(x, centre)]
        edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return cls(centre, [kmeans(rest[:, a:b], codes) for a, b in cuts], cuts)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the exact distance of each vector from what its code stands for."""
        at = nearest(x, self.centre)
        rest = x - self.centre[at]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], axis=1)
        known = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return at, codes.astype(np.uint8), np.linalg.norm(rest - known, axis=1)

    def probes(self, x: np.ndarray, at: np.ndarray, radius: float) -> np.ndarray:
        """[vectors, lists]: True where the list may hold a vector within the radius.

        Vectors of another list lie beyond the plane midway between its centre and the nearest one.
        """
        d = (x * x).sum(axis=1)[:, None] + (self.centre**2).sum(axis=1) - 2 * (x @ self.centre.T)
        own = d[np.arange(len(x)), at]
        gap = np.linalg.norm(self.centre[at][:, None, :] - self.centre[None], axis=2)
        beyond = (d - own[:, None]) / (2 * np.maximum(gap, 1e-12))
        return (beyond <= radius + _SLACK) | (gap <= 1e-12)

    def table_distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """[queries, vectors]: distance of each query from what each vector's code stands for."""
        rest = x - self.centre[cell]
        total = np.zeros((len(x), len(codes)))
        for i, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            table = ((rest[:, a:b, None] - book.T[None]) ** 2).sum(axis=1)
            total += table[:, codes[:, i]]
        return np.sqrt(total)


def _file(book, radius: float):
    """Rows (uid, node, copies, grp, v) with list, code, error and the lists to probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = book.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                v = matrix(b.column(4))
                x = v / np.linalg.norm(v, axis=1)[:, None]
                at, codes, err = b_.code(x)
                probes = b_.probes(x, at, radius)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i) for i in range(5)), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err),
                        pa.array([np.flatnonzero(p).astype(np.int32) for p in probes], pa.list_(pa.int32())),
                    ],
                    names=["uid", "node", "copies", "grp", "v", "cell", "codes", "err", "probes"],
                )

    return run


def _match(book, cosine: float, radius: float):
    """One list's part against one part of its queries: link counts by query, and edges that join what is linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, cell = book.value, int(pdf["cell"].iloc[0])
        is_query = pdf["query"].to_numpy()
        q, p = pdf[is_query], pdf[~is_query]
        if not len(q) or not len(p):
            return pd.DataFrame({"uid": [], "n": [], "a": [], "b": []})
        vq, vp = np.stack(q["v"].to_numpy()).astype(np.float64), np.stack(p["v"].to_numpy()).astype(np.float64)
        nq, np_ = np.linalg.norm(vq, axis=1), np.linalg.norm(vp, axis=1)
        codes = np.frombuffer(b"".join(p["codes"]), np.uint8).reshape(len(p), -1)
        err, copies = p["err"].to_numpy(), p["copies"].to_numpy()
        uq, up = q["uid"].to_numpy(), p["uid"].to_numpy()
        counts = np.zeros(len(q), np.int64)
        left, right = [], []
        for lo in range(0, len(q), 256):
            part = slice(lo, lo + 256)
            near = b.table_distances(vq[part] / nq[part, None], cell, codes) - err <= radius + _SLACK
            near &= uq[part, None] != up[None]
            i, j = np.nonzero(near)
            ok = np.concatenate([np.einsum("ij,ij->i", vq[i[s : s + 65536] + lo], vp[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            ok = ok / (nq[i + lo] * np_[j]) >= cosine
            i, j = i[ok] + lo, j[ok]
            counts += np.bincount(i, weights=copies[j], minlength=len(q)).astype(np.int64)
            left.append(i)
            right.append(j)
        i, j = np.concatenate(left), np.concatenate(right)
        # a forest of the links found: breadth-first by smallest label
        label = np.concatenate([np.arange(len(q)), len(q) + np.arange(len(p))])
        while len(i):
            low = np.minimum(label[i], label[len(q) + j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, len(q) + j, low)
            if np.array_equal(new, label):
                break
            label = new
        nodes = np.concatenate([q["node"].to_numpy(dtype=object), p["node"].to_numpy(dtype=object)])
        moved = np.flatnonzero(label != np.arange(len(label)))
        edges = {(x, y) for x, y in zip(nodes[moved], nodes[label[moved]]) if not (pd.isna(x) or pd.isna(y)) and x != y}
        hit = counts > 0
        out = [(u, n, None, None) for u, n in zip(uq[hit].tolist(), counts[hit].tolist())] + [(None, None, int(x), int(y)) for x, y in edges]
        return pd.DataFrame(out, columns=["uid", "n", "a", "b"]).astype("Int64")

    return run


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, *, train: int = 20_000, list_size: int = 2048, max_lists: int = 1024, subspaces: int = 8, codes: int = 32, part: int = 2000
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Vectors are compared where labels are equal and not null and lengths are equal. Null, empty and zero
    vectors, and such with null or non-finite components, link with nothing; finite ones of any size are compared. Vectors that are equal
    but for a power of two are filed once, with their number. Rows that share a vec_id are one node of the graph; a null vec_id keeps its row and names no component.

    Codebooks are fitted on at most ``train`` vectors, by hash. Every vector is filed and every one is a query.
    Lists and their queries are split into parts of about ``part`` rows, so a group of near copies of any size is
    worked off in blocks that return counts and a forest, never pairs. Links between two vectors are found from both sides.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pq")
    radius = float(np.sqrt(2 - 2 * cosine))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    good = F.coalesce(usable(F.col("v")) & F.col("label").isNotNull() & (top > 0), F.lit(False))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(top)))  # by a power of two, which changes no digit, so that no square overflows or vanishes
    rows = rows.withColumns({"good": good, "unit": unit}).withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x / F.col("unit"))).otherwise(F.col("v")))
    rows = scratch.save(rows.drop("unit"))
    grp = F.concat_ws(":", F.size("v").cast("string"), "label")
    classes = rows.where("good").withColumn("grp", grp).groupBy("grp", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("node"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("uid"), "node", "copies", "grp", "v"))

    found, edges = [], []
    for size, n in sorted((r["size"], r["count"]) for r in classes.groupBy(F.size("v").alias("size")).count().collect()):
        own = classes.where(F.size("v") == size)
        x = sample(own, "v", train)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        book = spark.sparkContext.broadcast(Codebook.fit(x, max(1, min(max_lists, n // list_size)), subspaces, codes))
        filed = own.mapInArrow(_file(book, radius), "uid long, node long, copies long, grp string, v array<double>, cell int, codes binary, err double, probes array<int>")
        filed = scratch.save(filed)
        homes = filed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
        asked = filed.select("grp", F.explode("probes").alias("cell")).groupBy("grp", "cell").agg(F.ceil(F.count("*") / part).cast("int").alias("rounds"))
        sizes = scratch.save(homes.join(asked, ["grp", "cell"]))
        salt = lambda n_, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(n_)).cast("int")
        columns = ["uid", "node", "copies", "grp", "cell", "v", "codes", "err"]
        home = filed.select(*columns).join(sizes, ["grp", "cell"]).withColumns({"p": salt("parts", 1), "q": F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))})
        query = filed.withColumn("cell", F.explode("probes")).select(*columns).join(sizes, ["grp", "cell"])
        query = query.withColumns({"q": salt("rounds", 2), "p": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
        keys = ["grp", "cell", "p", "q"]
        query = query.withColumns({"codes": F.lit(None).cast("binary"), "err": F.lit(None).cast("double")})
        both = home.select(*columns, "p", "q", F.lit(False).alias("query")).unionByName(query.select(*columns, "p", "q", F.lit(True).alias("query")))
        hits = scratch.save(both.groupBy(*keys).applyInPandas(_match(book, cosine, radius), "uid long, n long, a long, b long"))
        found.append(hits.where("uid is not null").select("uid", "n"))
        edges.append(hits.where("a is not null").select("a", "b"))

    rest = F.lit(0).cast("long").alias("n_links")
    out = rows.where("not good").select("vec_id", rest, F.col("vec_id").alias("component_id"))
    if found:
        links, graph = found[0], edges[0]
        for x, y in zip(found[1:], edges[1:]):
            links, graph = links.unionByName(x), graph.unionByName(y)
        comp = components(graph, scratch)
        links = links.groupBy("uid").agg(F.sum("n").alias("n"))
        done = classes.join(links, "uid", "left").join(comp, "node", "left")
        done = scratch.save(done.select("grp", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
        scratch.keep(rows, done)
        some = rows.where("good").withColumn("grp", grp).join(done, ["grp", "v"])
        out = out.unionByName(some.select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
