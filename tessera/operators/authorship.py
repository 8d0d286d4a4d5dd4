"""Authorship signals from a bigram language model of the corpus itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions import text as T
from tessera.operators import products

ADD = 0.5


BUCKET = 4 << 20  #: bytes of the texts' table for each bucket of pairs
CHUNK = 8 << 20  #: bytes of the texts' table for each chunk of texts whose pairs are sent once


def _words(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, w array<long>): hashes of a text's words after a start mark; rows without words are left out."""
    w = T.words(F.lower("text"))
    rows = rows.select(*key, w.alias("w")).where(F.size("w") > 0)
    return rows.select(*key, F.transform(F.concat(F.array(F.lit("<s>")), "w"), lambda x: F.xxhash64(x)).alias("w"))


def _buckets(texts: DataFrame, each: int = BUCKET) -> int:
    """Buckets, or chunks, by the planner's size of the texts; a plan of unknown size has 64."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(4096, size // each + 8) if size < 1 << 60 else 64


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hashes of pairs of words, from theirs."""
    pair = first * np.uint64(0x9E3779B97F4A7C15) + second
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return pair ^ (pair >> np.uint64(32))


def _entries(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """(kind, bucket, keys, n, h, k): a row for each bucket of each Arrow batch, with the distinct pairs (kind 0) and first words (kind 1) of
    its texts by hash, how often each occurs (k), and how many stand for each text (n), whose keys are alongside. So a pair costs its hash and count, no row."""
    kinds = dict(rows.dtypes)
    schema = "kind int, bucket int, " + "".join(f"{c} array<{kinds[c]}>, " for c in key) + "n array<int>, h array<long>, k array<int>"

    def run(batches):
        for batch in batches:
            at = batch.column(len(key))
            size = at.value_lengths().to_numpy(zero_copy_only=False)
            w, row = at.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(size)), size)
            if not len(w):
                continue
            both = row[1:] == row[:-1]
            first, row = w[:-1][both], row[:-1][both]
            pair = _mixed(first, w[1:][both])
            for kind, h in enumerate((pair, first)):
                r, bucket = row if key else np.zeros_like(row), (h % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((h, r, bucket))
                r, bucket, h = r[order], bucket[order], h[order]
                cut = lambda *xs: np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in xs], axis=0)]))
                one = cut(bucket, r, h)
                k = np.diff(np.append(one, len(h)))
                r, bucket, h = r[one], bucket[one], h[one]
                runs = cut(bucket, r)
                own, rb = cut(bucket), bucket[runs]
                lists = lambda offsets, n, x: pa.ListArray.from_arrays(pa.array(np.append(offsets, n), pa.int32()), x)
                by_run = lambda x: lists(cut(rb), len(runs), x)
                by_entry = lambda x: lists(own, len(h), x)
                cols = [pa.array(np.full(len(own), kind), pa.int32()), pa.array(bucket[own]), *(by_run(batch.column(i).take(pa.array(r[runs]))) for i in range(len(key)))]
                cols += [by_run(pa.array(np.diff(np.append(runs, len(h))), pa.int32())), by_entry(pa.array(h.view(np.int64))), by_entry(pa.array(k, pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["kind", "bucket", *key, "n", "h", "k"])

    return rows.mapInArrow(run, schema)


def _flat(rows: pa.Table, c: str) -> pa.Array:
    x = rows[c].combine_chunks()
    return (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten()


def _sums(key: list[str], add: float):
    """A bucket's counts in the model's texts, and for each asked text the sum of its logarithms and how many pairs they are."""

    def run(own: tuple, model: pa.Table, rows: pa.Table) -> pa.Table:
        kind, h, k = own[0].as_py(), *(_flat(rows, c).to_numpy() for c in ("h", "k"))
        known, at = np.unique(_flat(model, "h").to_numpy(), return_inverse=True)
        counts = np.bincount(at, _flat(model, "k").to_numpy(), len(known))
        place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        n = np.where(known[place] == h, counts[place], 0.0) if len(known) else np.zeros(len(h))
        value = np.log(n + add) if kind == 0 else -np.log(n + add * rows["v"][0].as_py()) if len(h) else n
        size = _flat(rows, "n").to_numpy()
        run = np.repeat(np.arange(len(size)), size)
        sums, pairs = np.bincount(run, value * k, len(size)), np.bincount(run, k, len(size)) * (kind == 0)
        return pa.table({**{c: _flat(rows, c) for c in key}, "s": pa.array(sums), "k": pa.array(pairs.astype(np.int64))})

    return run


class BigramModel:
    """Counts of word pairs, of their first words, and the vocabulary's size, over whole texts.

    Substitutes a transformer model: the perplexity's scale differs, so its thresholds need calibration. Words and pairs are told apart by
    64-bit hashes. The mean of log (n12 + add) / (n1 + add * v) is that of log (n12 + add) less that of log (n1 + add * v), so a text's pairs and its first words
    are dealt out by hash apart from one another, each once, and a frequent first word is a row of no text more than once.
    """

    def __init__(self, texts: DataFrame, add: float = ADD):
        self.texts = texts
        words = _words(texts, [])
        self.buckets = _buckets(texts)
        self.entries = _entries(words, [], self.buckets)
        self.size = words.select(F.explode(F.array_distinct(F.slice("w", 2, F.size("w") - 1))).alias("w")).agg(F.count_distinct("w").alias("v"))
        self.add = add

    def perplexity(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """(key, perplexity) of rows (key, text), keys distinct: exp of the mean negative log-probability; none for blank texts."""
        asked = _entries(_words(rows, key), key, self.buckets).crossJoin(F.broadcast(self.size))  # one row
        kinds = dict(rows.dtypes)
        both = self.entries.groupBy("kind", "bucket").cogroup(asked.groupBy("kind", "bucket"))
        sums = both.applyInArrow(_sums(key, self.add), "".join(f"{c} {kinds[c]}, " for c in key) + "s double, k long")
        return sums.groupBy(*key).agg(F.exp(-F.sum("s") / F.sum("k")).alias("perplexity"))


class _Chunk:
    """The pairs of the words of some texts and of their chosen sentences (i > 0): the distinct hashes of pairs and of words in order, how often the texts have each
    (as the first of a pair, for words), which words stand second there, and which of the hashes each occurrence is."""

    def __init__(self, rows: pa.Table):
        at = rows["w"].combine_chunks()
        size = at.value_lengths().to_numpy(zero_copy_only=False)
        w, line = at.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(size)), size)
        both = np.flatnonzero(line[1:] == line[:-1])
        self.line, first, second = line[both], w[both], w[both + 1]
        whole = (rows["i"].to_numpy() == 0)[self.line]
        pairs, pair = np.unique(_mixed(first, second), return_inverse=True)
        words, word = np.unique(np.concatenate([first, second[whole]]), return_inverse=True)
        word, then = word[: len(first)], word[len(first) :]
        self.hashes, self.places = (pairs, words), (pair, word)
        self.counts = [np.bincount(x[whole], minlength=len(h)) for x, h in zip(self.places, self.hashes)]
        self.second = np.bincount(then, minlength=len(words)) > 0


def _own_perplexities(docs: DataFrame, add: float) -> DataFrame:
    """(doc, i, perplexity) of the texts (i = 0) and of their chosen sentences (from 1), by a model of the same texts.

    Texts are dealt out in chunks. A chunk sends each distinct pair and word once to its bucket, in order and as differences, and gets back how often all texts have each, in the same order and without
    its hash. So neither a text nor a sentence sends its pairs, a text's pairs are not sent again for the model, and the texts are shuffled once.
    """
    bits = max(1, (_buckets(docs) - 1).bit_length())
    dealt = docs.select(F.pmod(F.xxhash64("doc"), F.lit(_buckets(docs, CHUNK))).cast("int").alias("chunk"), "doc", "text").repartition("chunk")
    parts = dealt.select("chunk", "doc", F.posexplode(F.concat(F.array("text"), _chosen(F.col("text")))).alias("i", "text"))
    words = _words(parts, ["chunk", "doc", "i"])

    def sent(key: tuple, rows: pa.Table) -> pa.Table:
        chunk, out = _Chunk(rows), []
        for kind, (h, k) in enumerate(zip(chunk.hashes, chunk.counts)):
            bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for lo, hi in zip(cut, cut[1:]):
                own = h[lo:hi]
                seen = np.packbits(chunk.second[lo:hi]).tobytes() if kind else b""
                out.append((kind, int(bucket[lo]), products.packed_numbers(np.diff(own, prepend=own[0] & ~np.uint64((1 << 64 - bits) - 1))), products.packed_numbers(k[lo:hi]), seen))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)]
        return pa.table([pa.repeat(key[0], len(out)), *columns], names=["chunk", "kind", "bucket", "h", "k", "second"])

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        start = np.uint64(key[1].as_py()) << np.uint64(64 - bits)
        own = [start + np.cumsum(products.unpacked_numbers(x), dtype=np.uint64) for x in rows["h"].to_pylist()]
        size = np.array(list(map(len, own)))
        known, at = np.unique(np.concatenate(own), return_inverse=True)
        k = np.concatenate([products.unpacked_numbers(x) for x in rows["k"].to_pylist()])
        n = np.bincount(at, k, len(known)).astype(np.int64)[at]
        v = 0
        if key[0].as_py():
            second = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=s) for x, s in zip(rows["second"].to_pylist(), size.tolist())])
            v = len(np.unique(at[second > 0]))
        ends = np.cumsum(size)
        back = pa.array([products.packed_numbers(n[hi - s : hi]) for s, hi in zip(size, ends)], pa.binary())
        return pa.table({"chunk": rows["chunk"], "kind": rows["kind"], "bucket": rows["bucket"], "n": back, "v": pa.array([v] + [0] * (len(size) - 1), pa.int64())})

    def scored(rows: pa.Table, counts: pa.Table) -> pa.Table:
        chunk = _Chunk(rows)
        counts = counts.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kind, n = counts["kind"].to_numpy(), [products.unpacked_numbers(x).astype(np.float64) for x in counts["n"].to_pylist()]
        total = [np.concatenate([np.empty(0), *(x for x, own in zip(n, kind) if own == i)]) for i in (0, 1)]
        of = counts["of"][0].as_py() if len(counts) else 0
        value = np.log(total[0] + add)[chunk.places[0]] - np.log(total[1] + add * of)[chunk.places[1]]
        size = np.bincount(chunk.line, minlength=rows.num_rows)
        return pa.table({"doc": rows["doc"], "i": rows["i"], "perplexity": pa.array(np.exp(-np.bincount(chunk.line, value, rows.num_rows) / size))})

    kind = dict(docs.dtypes)["doc"]
    lists = words.groupBy("chunk").applyInArrow(sent, "chunk int, kind int, bucket int, h binary, k binary, second binary")
    counts = lists.groupBy("kind", "bucket").applyInArrow(counted, "chunk int, kind int, bucket int, n binary, v long")
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("v").alias("of"))))  # one row
    return words.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(scored, f"doc {kind}, i int, perplexity double")


class ScoredBy:
    """A user's function from a text column to its perplexity, such as a ``pandas_udf`` around a language model, in the bigram model's place."""

    def __init__(self, score):
        self.score = score

    def perplexity(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """(key, perplexity) of rows (key, text); none for blank texts and where the function gives null."""
        some = rows.where(F.length(F.trim("text")) > 0)
        return some.select(*key, self.score(F.col("text")).cast("double").alias("perplexity")).where("perplexity is not null")


def _chosen(text: Column, most: int = 12) -> Column:
    """Sentences of more than five words; of more than twelve, twelve evenly spaced; none if fewer than three."""
    long = F.filter(T.sentences(text), lambda x: F.size(T.words(x)) > 5)
    spaced = lambda s: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(s, F.floor(i * (F.size(s) - 1) / (most - 1)).cast("int")))
    return T.let(long, lambda s: F.when(F.size(s) > most, spaced(s)).when(F.size(s) >= 3, s).otherwise(F.array().cast("array<string>")))


def long_sentences(docs: DataFrame, most: int = 12) -> DataFrame:
    """(doc, i, text): the sentences of ``_chosen``."""
    return docs.select("doc", F.posexplode(_chosen(F.col("text"), most)).alias("i", "text"))


def burstiness(docs: DataFrame, model: BigramModel) -> DataFrame:
    """(doc, burstiness): population variance of the chosen sentences' perplexities."""
    return model.perplexity(long_sentences(docs), ["doc", "i"]).groupBy("doc").agg(F.var_pop("perplexity").alias("burstiness"))


def signals(docs: DataFrame, model: BigramModel) -> DataFrame:
    """(doc, perplexity, burstiness, stylometric); a signal that a text doesn't give is null. Texts and sentences meet the model together, and where it is a model of these texts, these are not counted apart."""
    style = docs.select("doc", T.stylometric(F.col("text")).alias("stylometric"))
    if isinstance(model, BigramModel) and model.texts is docs:
        parts = _own_perplexities(docs, model.add).withColumn("i", F.col("i") - 1)
    else:
        parts = model.perplexity(docs.select("doc", F.lit(-1).alias("i"), "text").unionByName(long_sentences(docs)), ["doc", "i"])
    found = parts.groupBy("doc").agg(F.max(F.when(F.col("i") < 0, F.col("perplexity"))).alias("perplexity"), F.var_pop(F.when(F.col("i") >= 0, F.col("perplexity"))).alias("burstiness"))
    return style.join(found, "doc", "left")


def probability(rows: DataFrame, model=None, external: DataFrame | None = None) -> DataFrame:
    """Adds ai_prob and source: a classifier where it is given and every signal is there, else the heuristic;
    averaged with an external score where there is one."""
    local = scores.heuristic_probability(F.col("perplexity"), F.col("burstiness"), F.col("stylometric"))
    if model is not None:
        from pyspark.ml.functions import vector_to_array

        names, columns = ["perplexity", "burstiness", "stylometric"], rows.columns
        filled = rows.select("*", *(F.col(c).alias(f"_{c}") for c in names)).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})
        p1 = F.when(F.expr(" and ".join(f"_{c} is not null" for c in names)), vector_to_array("probability")[1])
        rows = model.transform(filled).select(*(F.col(f"_{c}").alias(c) if c in names else c for c in columns), p1.alias("_p"))
        local = F.coalesce("_p", local)
    rows = rows.join(external.select("doc", "api_score"), "doc", "left") if external is not None else rows.withColumn("api_score", F.lit(None).cast("double"))
    p, source = scores.blended(local, F.col("api_score"))
    return rows.withColumns({"ai_prob": p, "source": source}).drop("_p")


def unscored(docs: DataFrame, results: DataFrame) -> DataFrame:
    return docs.join(results.select("doc"), "doc", "left_anti")
