"""Divergence of sources by language: three-dimensional cube partitioning.

Terms are counted by language and source. Every source of a language is in one of its group blocks, every term in one of its
term blocks, and a task owns cells (group block, group block, term block): it gets the slices of counts of its two group
blocks, each replicated to all cells that need it, and computes partial divergences of all pairs across them. Partial sums
are added along the term axis. What no source of a cell has is left out there and added in closed form at the end, so
that the work follows the counts that occur. All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.scratch import Scratch

SCALE = 1_000_000_000
_KEEP = np.array([b if 97 <= b <= 122 or b >= 0x80 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8).tobytes()


def terms(data: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of ASCII letters and of everything outside ASCII, A-Z lower-cased, some megabytes of a text at a time."""
    data = data.translate(_KEEP)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + piece) if at + piece < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term, and of the empty term one row without any for each group.

    Null text, lang and source are ''. Counts are added in each task, which holds at most ``most`` terms besides those of
    the document at hand, and once more by group before a term's groups meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        d: dict[tuple, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                size, docs_ = len(own) + 1, d[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([b"", *own], pa.binary()).cast(pa.string()),
                        pa.array([0, *own.values()], pa.int64()), pa.array([0, *(docs_[t] for t in own)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "d"],
                )
            n.clear()
            d.clear()

        held = 0
        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                key = (lang or "", source or "")
                own: Counter = Counter()
                for part in terms((text or "").encode()):
                    own.update(part)
                all_n, all_d = n.setdefault(key, Counter()), d.setdefault(key, Counter())
                held -= len(all_n)
                all_n.update(own)
                all_d.update(own.keys())
                held += len(all_n)
                if held > most or len(n) > most:
                    yield from out()
                    held = 0
        yield from out()

    rows = docs.select(*(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def smoothed(count: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals that hold every product."""
    up = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, (total + 2 * terms_).cast("decimal(20,0)"))


def apart(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers up to SCALE + 1: the square fits 64 bits."""
    return (p - q) * (p - q) // (p + q)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell's partial sums (lang, a, b, part, covered) for a < b: over the terms that any of its sources has.

    A row is a source's value of a term, or, without a term, its value where it has none, once for each source.
    """
    slim = rows[rows["term"].isna()].sort_values("source")
    some = rows[rows["term"].notna()]
    name, block = slim["source"].to_numpy(), slim["block"].to_numpy()
    term, t = np.unique(some["term"].to_numpy(), return_inverse=True)
    p = np.repeat(slim["p"].to_numpy()[:, None], len(term), 1)
    p[np.searchsorted(name, some["source"].to_numpy()), t] = some["p"].to_numpy()
    i, j = int(rows["bi"].iloc[0]), int(rows["bj"].iloc[0])
    out = []
    for x in np.flatnonzero(block == i):
        other = np.flatnonzero((block == j) & ((name > name[x]) if i == j else np.ones(len(name), bool)))
        if len(other):
            value = apart(p[other], p[x][None]).sum(axis=1)
            out += [(*sorted((name[x], name[y])), int(v)) for y, v in zip(other, value)]
    return pd.DataFrame(out, columns=["a", "b", "part"]).assign(lang=rows["lang"].iloc[0], covered=len(term))[["lang", "a", "b", "part", "covered"]]


def pair_divergences(kept: DataFrame, groups: DataFrame, *, group_block: int = 32, term_block: int = 512) -> DataFrame:
    """(lang, a, b, value) of all pairs a < b of a language's sources.

    kept: (lang, source, term, p) of the counts that occur; groups: (lang, source, p0, n_groups, n_terms), every source once.
    A source's rows, with one more for each term block, go to as many cells as its language has group blocks; a cell has at most 2 * group_block sources (as hashing
    spreads them) and term_block terms, however many there are in all.
    """
    size = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    placed = groups.select("lang", "source", "p0", size("n_groups", group_block).alias("gb"), size("n_terms", term_block).alias("tb"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("source"), "gb").cast("int"))
    where = [F.col("gb"), F.col("block")]
    rows = kept.select("lang", "source", "term", "p").join(placed.drop("p0"), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "p", *where, F.pmod(F.xxhash64("term"), "tb").cast("int").alias("tb"))
    slim = placed.where("tb > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), *where, F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("tb"))
    rows = rows.unionByName(slim).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)))
    cells = rows.select("lang", "source", "term", "p", "block", F.least("block", "to").alias("bi"), F.greatest("block", "to").alias("bj"), "tb")
    part = cells.groupBy("lang", "bi", "bj", "tb").applyInPandas(_cell, "lang string, a string, b string, part long, covered long")
    part = part.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("covered").alias("covered"))
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa"), "n_terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb"))
    pairs = a.join(b, "lang").where("a < b").join(part, ["lang", "a", "b"], "left")
    none = F.lit(0).cast("long")
    rest = (F.col("n_terms") - F.coalesce("covered", none)) * F.expr("(pa - pb) * (pa - pb) div (pa + pb)")
    return pairs.select("lang", "a", "b", F.when(F.col("n_terms") > 0, F.coalesce("part", none) + rest).otherwise(none).alias("value"))


def audit(docs: DataFrame, *, least: int = 10, most: int = 10, group_block: int = 32, term_block: int = 512) -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source) that occurs in (text, lang, source).

    A language keeps the terms of at least ``least`` of its documents; each row is a document, also where rows repeat. Part
    ``pair``: every other source of the language with the divergence from it, all ranks. Part ``term``: the group's own terms that
    are likelier in it than in its language, by falling distance, the first ``most``. Ties go to the item that is less
    in UTF-8. Null text, lang and source are ''; groups without terms have pairs, and no terms of their own. Other columns are
    ignored; an empty table gives no rows. Counts are exact up to 9 * 10^18 occurrences.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(term_counts(docs))
    some = counts.where("term != ''")
    by_term = some.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("docs")).where(F.col("docs") >= least).drop("docs")
    own = scratch.save(some.select("lang", "source", "term", "n").join(by_term, ["lang", "term"]))
    none = F.lit(0).cast("long")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", none))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("n_groups"))
    langs = langs.join(by_term.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang", "left").withColumn("n_terms", F.coalesce("n_terms", none))
    n = F.col("n_terms")
    groups = groups.join(langs, "lang").withColumn("p0", F.when(n > 0, smoothed(none, F.col("total"), n)).otherwise(F.lit(1).cast("long")))
    groups = scratch.save(groups)
    rows = own.join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "term", smoothed(F.col("n"), F.col("total"), n).alias("p"), smoothed(F.col("n_lang"), F.col("lang_total"), n).alias("q"))
    rows = scratch.save(rows)
    pairs = scratch.save(pair_divergences(rows, groups, group_block=group_block, term_block=term_block))
    scratch.keep(rows, pairs)
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = both.withColumn("rank", rank)
    own_terms = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    own_terms = own_terms.withColumn("rank", rank).where(F.col("rank") <= most)
    out = both.withColumn("part", F.lit("pair")).unionByName(own_terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
