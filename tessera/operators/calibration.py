"""Monotone curves from a signal's own scale to the one that the thresholds are for, learned from labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 4  #: bins to a factor of e


def bin_of(value: Column) -> Column:
    """Number of the bin of a positive value; values up to 1 are in bin 0."""
    return F.floor(F.log(F.greatest(value, F.lit(1.0))) * STEP).cast("int")


def pooled(bins: list[tuple[int, int, int]]) -> list[tuple[int, float]]:
    """The falling curve of least squared error through the shares of ones in (bin, n, ones): neighbours that rise are pooled until none does."""
    blocks: list[list] = []  # bins, n, ones
    for b, n, ones in sorted(bins):
        blocks.append([[b], n, ones])
        while len(blocks) > 1 and blocks[-1][2] * blocks[-2][1] > blocks[-2][2] * blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return [(b, ones / n) for own, n, ones in blocks for b in own]


@dataclass(frozen=True)
class Curve:
    """Probability of label 1 by bin; values between known bins have the probability of the one below, those below all that of the first."""

    points: tuple[tuple[int, float], ...]

    @classmethod
    def fit(cls, rows: DataFrame, value: str, y: str) -> Curve:
        """Of labelled rows; rows without value or label are left out. What reaches the driver is a row for each bin, some hundreds at most."""
        some = rows.where(F.col(value).isNotNull() & F.col(y).isNotNull())
        counts = some.groupBy(bin_of(F.col(value)).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("ones")).collect()
        return cls(tuple(pooled([(r["bin"], r["n"], r["ones"]) for r in counts])))

    def probability(self, value: Column) -> Column:
        """Null where the value is, or where nothing was learned."""
        if not self.points:
            return F.lit(None).cast("double")
        b, out = bin_of(value), F.lit(self.points[0][1])
        for at, p in self.points:
            out = F.when(b >= at, p).otherwise(out)
        return F.when(value.isNotNull(), out)

    def perplexity(self, value: Column) -> Column:
        """On the scale where 20 stands for certainly generated and 200 for certainly not, as ``scores.heuristic_probability`` reads it."""
        return 20 + 180 * (1 - self.probability(value))

    def burstiness(self, value: Column) -> Column:
        """On the scale where 0 stands for certainly generated and 100 for certainly not."""
        return 100 * (1 - self.probability(value))


def calibrated(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """The signals (doc, perplexity, burstiness, ...) with both on the scales of the thresholds, by curves learned from labels (doc, y) on the same signals.

    Where the labels say nothing of a signal, curves are flat, and it says nothing afterwards, either.
    """
    known = signals.join(labels.select("doc", "y"), "doc")
    ppl, burst = Curve.fit(known, "perplexity", "y"), Curve.fit(known, "burstiness", "y")
    return signals.withColumns({"perplexity": ppl.perplexity(F.col("perplexity")), "burstiness": burst.burstiness(F.col("burstiness"))})
