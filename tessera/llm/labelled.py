"""A bounded, fixed sample of labelled documents, and the split that keeps a part held out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Of (key, size) in order, the keys whose sizes fit into ``most`` together; one that does not fit is passed over."""
    out, left = [], most
    for key, n in sizes:
        if n <= left:
            out.append(key)
            left -= n
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, chars: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out part, the same at every run.

    In order of a hash they are taken as long as they have no more than ``chars`` characters together; a document that does not
    fit is passed over, and the rest go on. A doc_id with contradicting labels counts as the larger, one with several texts
    has the smallest; null labels and null texts are left out. The sampled ids, at most ``limit`` of them, are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("y is not null and doc_id is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = text.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = Scratch(docs.sparkSession, "labelled").save(rows.withColumn("h", F.xxhash64("doc_id")))
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in rows.select("h", "doc_id", F.length("text").alias("n")).collect())
    taken = fitting([(i, n) for _, i, n in sizes], chars)
    return (rows.where(F.col("doc_id").isin(taken)) if len(taken) < len(sizes) else rows).select("doc_id", "text", "y")


def keep_rows(docs: DataFrame, model, wanted: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows whose text's score is wanted, with all their columns. The model is of fixed size."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(wanted(shared.value.score(b.column(at).cast(pa.string()).to_pylist()))))

    return docs.mapInArrow(run, docs.schema)
