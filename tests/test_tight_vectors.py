"""Weighted vectors as a few bytes a term give the products of those with a number a term, and terms that no vector keeps are not shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import products, similarity
from tessera.params import TfidfParams


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [("b" if i % 4 else "c", i, " ".join(f"word{int(300 * rng.random() ** 2)}" for _ in range(rng.randrange(60)))) for i in range(90)]
    return spark.createDataFrame([*rows, ("lone", 90, "alone here"), ("none", 91, "")], "batch string, doc long, text string").localCheckpoint()


@pytest.mark.parametrize("most", [40, 10_000])
def test_tight_products(spark, docs, most):
    loose = similarity.tfidf_packed(docs, TfidfParams(max_terms=most)).select("batch", "doc", "at", "weight")
    tight, scales = similarity.tfidf_tight(docs, TfidfParams(max_terms=most))
    assert max(len(r["weight"]) for r in tight.collect()) < 8 + 1 + 60 * 2
    for block in (512, 5):
        for least in (0.0, 0.03, None):
            want = sorted(map(tuple, products.all_pairs(loose, least, block=block).collect()))
            got = sorted(map(tuple, products.all_pairs(tight, least, block=block, scales=scales).collect()))
            assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12) and len(want) > 20
    want, got = ({r["doc"]: r["value"] for r in found.collect()} for found in (products.greatest(loose), products.greatest(tight, scales=scales)))
    assert want.keys() == got.keys() and all(abs(want[d] - got[d]) < 1e-12 for d in want)


def test_terms_that_are_not_kept_are_not_dealt(spark, docs):
    dealt = similarity._dealt(docs, TfidfParams(max_terms=40))[0]
    counts = similarity.term_counts(docs)
    n = dealt.agg(F.sum(F.size("hash"))).first()[0]
    assert 0 < n < counts.agg(F.sum(F.size("term"))).first()[0] / 3
