"""Quality by supervised subword embeddings.

Every word of a text, and every piece of 3 to 5 characters of it with its borders, has a learned vector in a hashed
table; a document is their average, and a softmax layer reads it. Trained by stochastic gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, keep_rows, training_rows
from tessera.llm.words import chunks, scan

BUCKETS = 1 << 18
PIECES = (3, 4, 5)
_SALT = np.uint64(0x2545F4914F6CDD1D)
_MASK = np.uint64(BUCKETS - 1)


def _walk(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of words, then of the pieces of each length, with repeats."""
    s = scan(texts)
    yield s.doc, ((s.hash(s.start, s.end) ^ _SALT) & _MASK).astype(np.int64)
    at = np.flatnonzero((s.data & 0xC0) != 0x80)  # where characters begin
    n = len(at)
    ends = np.cumsum(s.data[at] == 32)
    row = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
    at = np.append(at, len(s.data))
    for k in PIECES:
        if n < k:
            continue
        inside = (ends[k - 2 : n - 1] == ends[: n - k + 1]) & (row[k - 1 :] == row[: n - k + 1])  # of one text, no separator but at its ends
        i = np.flatnonzero(inside)
        yield row[i], (s.hash(at[i], at[i + k]) & _MASK).astype(np.int64)


def features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts, of each text."""
    row, f = (np.concatenate(x) for x in zip(*_walk(texts)))
    key, count = np.unique(row * BUCKETS + f, return_counts=True)
    cut = np.searchsorted(key, np.arange(1, len(texts)) * BUCKETS)
    return list(zip(np.split(key % BUCKETS, cut), np.split(count, cut)))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in chunks(texts):
            xs = features(texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [b.column(1).slice(lo, hi - lo), pa.array([x.astype("<i4").tobytes() for x, _ in xs], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in xs], pa.binary())],
                names=["y", "x", "n"],
            )


@dataclass
class QualityModel:
    gain: np.ndarray  # what each bucket adds to the averaged log-odds: its vector seen through the softmax layer
    bias: float

    @classmethod
    def fit(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], *, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> QualityModel:
        """rows: label, distinct buckets, their counts. One step a document, with a falling rate; vectors step eight times as far as the layer."""
        if not rows:  # nothing to learn from: every text scores a half
            return cls(np.zeros(BUCKETS, np.float32), 0.0)
        rng = np.random.default_rng(seed)
        v = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        y = np.array([r[0] for r in rows])
        prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        w, b = np.zeros((2, dim), np.float32), np.array([0, prior], np.float32)
        w[1] = rng.normal(0, 1, dim)
        w[0] = -w[1]
        total, done = max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                label, f, n = rows[i]
                step = rate * (1 - done / total)
                done += 1
                if not len(f):
                    continue
                share = n.astype(np.float32)
                share /= share.sum()
                own = v[f]
                h = share @ own
                z = w @ h + b
                p = np.exp(z - z.max())
                err = p / p.sum()
                err[label] -= 1
                v[f] = own - (step * 8) * share[:, None] * (err @ w)
                w -= step * np.outer(err, h)
                b -= step * 0.1 * err
        return cls(v @ (w[1] - w[0]), float(b[1] - b[0]))

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for lo, hi in chunks(texts):
            total, n = np.zeros(hi - lo), np.zeros(hi - lo)
            for row, f in _walk(texts[lo:hi]):
                total += np.bincount(row, weights=self.gain[f], minlength=hi - lo)
                n += np.bincount(row, minlength=hi - lo)
            out[lo:hi] += total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, chars: int = 24_000_000) -> QualityModel:
    """Fits on at most ``sample`` labelled documents of ``chars`` characters together, outside the held-out part; only hashed features are gathered."""
    found = training_rows(docs, labels, "quality", sample, chars).select("text", "y").mapInArrow(_collect, "y int, x binary, n binary").toLocalIterator()
    rows = sorted((r["y"], bytes(r["x"]), bytes(r["n"])) for r in found)
    return QualityModel.fit([(int(y > 0), np.frombuffer(x, "<i4"), np.frombuffer(n, "<u4")) for y, x, n in rows])


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score of every row.

    Null and empty texts have no features and score the model's prior. Rows are independent: repeated and
    null doc_ids keep theirs; other columns are ignored. The model is of fixed size (2 MB) and broadcast;
    nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.score(b.column(2).to_pylist()))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The rows that score the threshold or more, with all their columns."""
    return keep_rows(docs, model, lambda score: score >= threshold)
