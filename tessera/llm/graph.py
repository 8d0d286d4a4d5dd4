"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as (node, smallest node reached inside the batch)."""
    for b in batches:
        ends = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        at = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while len(nodes):
            low = np.minimum(root[at[0]], root[at[1]])
            new = root.copy()
            np.minimum.at(new, root[at[0]], low)
            np.minimum.at(new, root[at[1]], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) edges to (node, component): the smallest node reachable, for every node with an edge.

    Each round is two grouped minima (combined before the shuffle) and two equi-joins whose hot keys
    adaptive execution can split, so a hub that a third of all edges touch fits. Self-edges and
    edges with a null end are ignored. The number of rounds grows with the logarithm of the longest path.
    """
    a, b = edges.columns[:2]
    e = edges.where((F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = scratch.save(e.mapInArrow(_forest, "u long, v long").distinct())  # u > v
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.save(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e, low, large, low2)
        e = new
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
