"""Toxicity by a logistic model on word and word-prefix presence, regularised by counterfactuals.

Identity terms in labelled texts are swapped for others of their kind, and the model pays for every change
of score this makes, so a mention of a group carries no evidence of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, keep_rows, training_rows
from tessera.llm.words import chunks, scan

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = (
    ("he", "she"), ("his", "her"), ("himself", "herself"), ("man", "woman"), ("men", "women"), ("boy", "girl"), ("father", "mother"),
    ("brother", "sister"), ("son", "daughter"), ("husband", "wife"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"), ("american", "mexican", "chinese", "african", "european", "arab"),
    ("young", "old"), ("deaf", "blind", "disabled"), 
    ("er", "sie"), ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("vater", "mutter"), ("christlich", "muslimisch", "jüdisch"), ("deutsche", "türkische", "polnische"),
    ("il", "elle"), ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("père", "mère"), ("chrétien", "musulman", "juif"), ("français", "algérien", "portugais"),
    ("él", "ella"), ("hombre", "mujer"), ("hombres", "mujeres"), ("niño", "niña"), ("padre", "madre"), ("cristiano", "musulmán", "judío"), ("español", "mexicano", "marroquí"),
)
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(97, 123), *range(48, 58), *range(128, 256)]] = False
_SALT = np.uint64(0x5851F42D4C957F2D)


def swapped(text: str, kinds=IDENTITY) -> str:
    """The text with each identity term replaced by the next of its kind."""
    to = {a: ks[(i + 1) % len(ks)] for ks in kinds for i, a in enumerate(ks)}
    return re.sub(r"[^\W\d_]+", lambda m: to.get(m[0].lower(), m[0]), text)


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each text's distinct words and word beginnings."""
    s = scan(texts, _SEPARATOR)
    rows, out = [s.doc], [((s.hash(s.start, s.end) ^ _SALT) & np.uint64(BUCKETS - 1)).astype(np.int64)]
    for n in PREFIXES:
        full = s.end - s.start > n
        rows.append(s.doc[full])
        out.append((s.hash(s.start[full], s.start[full] + n) & np.uint64(BUCKETS - 1)).astype(np.int64))
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(out))
    return both // BUCKETS, both % BUCKETS


def _collect(kinds):
    """Each text's features, and those that the swap takes away and adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y = b.column(0).to_pylist(), b.column(1)
            for lo, hi in chunks(texts):
                own, other = (_by_row(features(ts), hi - lo) for ts in (texts[lo:hi], [swapped(t, kinds) for t in texts[lo:hi]]))
                cols = [own, [np.setdiff1d(x, z) for x, z in zip(own, other)], [np.setdiff1d(z, x) for x, z in zip(own, other)]]
                yield pa.RecordBatch.from_arrays([y.slice(lo, hi - lo), *(pa.array([x.astype("<i4").tobytes() for x in c], pa.binary()) for c in cols)], names=["y", "x", "lost", "won"])

    return run


def _by_row(found: tuple[np.ndarray, np.ndarray], n: int) -> list[np.ndarray]:
    return np.split(found[1], np.cumsum(np.bincount(found[0], minlength=n))[:-1])


@dataclass
class ToxicityModel:
    slot: np.ndarray  # of each bucket the number of its feature, or -1
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], *, counterfactual: float = 1.0, l2: float = 1e-4, most: int = 800, keep=(), steps: int = 300) -> ToxicityModel:
        """rows: label, buckets, buckets that the swap takes away and adds.

        Features are those whose share of either label lies more than three standard errors off, at most ``most`` of them by that measure.
        """
        slot = np.full(BUCKETS, -1, np.int16)
        y = np.array([r[0] for r in rows], np.float64)
        n, p = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
        for label, x, _, _ in rows:
            n[x] += 1
            p[x] += label
        rate = y.mean() if len(y) else 0.0
        if not len(rows) or rate in (0.0, 1.0):
            rate = min(max(rate, 0.01), 0.99)
            return cls(slot, np.zeros(1), float(np.log(rate / (1 - rate))))
        some = np.flatnonzero(n >= 3)
        z = np.abs(p[some] - rate * n[some]) / np.sqrt(n[some] * rate * (1 - rate))
        best = np.argsort(-z, kind="stable")[:most]
        chosen = np.unique(np.concatenate([some[best[z[best] > 3]], np.array([k for k in keep if n[k] > 0], np.int64)]))
        slot[chosen] = np.arange(len(chosen))
        m = len(chosen)
        x, delta = np.zeros((len(rows), m), np.float32), []
        for i, (_, own, lost, won) in enumerate(rows):
            f = slot[own]
            x[i, f[f >= 0]] = 1
            change = np.zeros(m, np.float32)
            for at, sign in ((lost, 1), (won, -1)):
                f = slot[at]
                change[f[f >= 0]] = sign
            if change.any():
                delta.append(change)
        moved, delta = len(delta), np.array(delta, np.float32).reshape(-1, m)
        w, bias = np.zeros(m), float(np.log(rate / (1 - rate)))
        g1, g2, b1, b2 = np.zeros(m + 1), np.zeros(m + 1), 0.9, 0.999
        for t in range(1, steps + 1):
            err = 1 / (1 + np.exp(-(x @ w.astype(np.float32) + bias))) - y
            grad = np.append(x.T @ err.astype(np.float32) / len(y) + l2 * w, err.mean())
            if moved:
                grad[:m] += 2 * counterfactual * delta.T @ (delta @ w.astype(np.float32)) / moved
            g1, g2 = b1 * g1 + (1 - b1) * grad, b2 * g2 + (1 - b2) * grad * grad
            step = 0.1 * (g1 / (1 - b1**t)) / (np.sqrt(g2 / (1 - b2**t)) + 1e-8)
            w, bias = w - step[:m], bias - step[m]
        return cls(slot, w, float(bias))

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for lo, hi in chunks(texts):
            row, f = features(texts[lo:hi])
            at = self.slot[f]
            hit = at >= 0
            out[lo:hi] += np.bincount(row[hit], weights=self.weight[at[hit]], minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, chars: int = 24_000_000, counterfactual: float = 1.0, most: int = 800, kinds=IDENTITY) -> ToxicityModel:
    """Fits on at most ``sample`` labelled documents of ``chars`` characters together, outside the held-out part.

    Only hashed features are gathered; the model has at most ``most`` of them, besides the identity terms.
    """
    found = training_rows(docs, labels, "toxic", sample, chars).select("text", "y").mapInArrow(_collect(kinds), "y int, x binary, lost binary, won binary")
    rows = sorted((r["y"], bytes(r["x"]), bytes(r["lost"]), bytes(r["won"])) for r in found.toLocalIterator())
    terms = features([w for ks in kinds for w in ks])[1]
    read = lambda x: np.frombuffer(x, "<i4")
    return ToxicityModel.fit([(int(y > 0), read(x), read(lost), read(won)) for y, x, lost, won in rows], counterfactual=counterfactual, most=most, keep=terms.tolist())


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score of every row.

    Null and empty texts score the model's prior. Rows are independent: repeated and null doc_ids keep
    theirs; other columns are ignored. The model is of fixed size (8 MB) and broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.score(b.column(2).to_pylist()))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    return keep_rows(docs, model, lambda score: score < threshold)
