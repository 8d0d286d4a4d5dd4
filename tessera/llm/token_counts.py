"""Exact token totals for every context limit from a histogram of encoded lengths.

Documents are aggregated by length; running sums over the lengths answer totals, quantiles and totals
after truncation, so no limit needs another pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.bpe import batches_of, encoder
from tessera.llm.scratch import Scratch

BIN = 128
LEVELS = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def length_histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs) of all documents; null and empty texts have no tokens.

    Each batch sends one row a length. Repeated rows and null doc_ids count; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            sizes = [e.lengths(texts) for texts in batches_of([t or "" for t in b.column(0).to_pylist()])]
            length, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sizes]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], names=["n_tokens", "n"])

    text = docs.select(F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def limits(histogram: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """For each length as the limit: documents and tokens up to it, documents beyond it, all tokens after truncation to it,
    and the levels whose quantile it is, comma-joined.

    The histogram is written first, so its texts are encoded once. Running sums go by bins of BIN lengths, then inside each bin, so no task sees all lengths. An empty histogram gives no rows.
    """
    rows = Scratch(histogram.sparkSession, "lengths").save(histogram).withColumn("bin", F.floor(F.col("n_tokens") / BIN))
    bins = rows.groupBy("bin").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row for BIN lengths
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    bins = bins.select("bin", F.coalesce(F.sum("d").over(earlier), none).alias("d0"), F.coalesce(F.sum("t").over(earlier), none).alias("t0"), F.sum("d").over(whole).alias("docs"))
    inside = Window.partitionBy("bin").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(bins, "bin").select(
        "n_tokens", "n_docs", "docs", (F.col("d0") + F.sum("n_docs").over(inside)).alias("docs_at_most"), (F.col("t0") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_at_most")
    )
    longer = F.col("docs") - F.col("docs_at_most")
    before = F.col("docs_at_most") - F.col("n_docs")
    level = F.array_join(F.filter(F.array(*map(F.lit, levels)), lambda q: (before < q * F.col("docs")) & (F.col("docs_at_most") >= q * F.col("docs"))).cast("array<string>"), ",")
    truncated = F.col("tokens_at_most") + longer * F.col("n_tokens")
    return rows.select("n_tokens", "n_docs", "docs_at_most", "tokens_at_most", longer.alias("docs_longer"), truncated.alias("truncated_total"), level.alias("quantiles"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the least length that at least the share q of the documents does not exceed."""
    return table.where(F.col("docs_at_most") >= q * (F.col("docs_at_most") + F.col("docs_longer"))).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row, total: all tokens when every document is cut to ``limit``, which need not be a length that occurs."""
    short = F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * limit))
    return table.agg(F.coalesce(short, F.lit(0)).alias("total"))
