"""Signals by a model of the same texts: equal to those of texts asked apart, with less sent."""

import math
import random

import numpy as np
import pytest

from tessera.operators import authorship, products


@pytest.mark.parametrize("chunk", [8 << 20, 40])
def test_signals_of_own_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(authorship, "CHUNK", chunk)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "The", "the", "<s>", "word", "w" + str(rng.randrange(200))])
    texts = [". ".join(" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["", "  ", "one", None, "x. y. z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").localCheckpoint()
    model = authorship.BigramModel(docs)
    found = authorship.signals(docs, model)
    want = {r["doc"]: r for r in authorship.signals(docs.select("doc", "text"), model).collect()}  # asked apart
    got = {r["doc"]: r for r in found.collect()}
    same = lambda x, y: x is None and y is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)
    assert got.keys() == want.keys() and all(same(got[d][c], want[d][c]) for d in want for c in ("perplexity", "burstiness", "stylometric"))
    assert sum(r["burstiness"] is not None for r in got.values()) > 30 and got[60]["perplexity"] is None

    steps = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Union" not in steps and steps.count("FlatMapCoGroupsInArrow") == 1
    lists = products.packed_numbers(np.array([1, 300, 2], "uint64"))
    assert len(lists) == 7 and products.unpacked_numbers(lists).tolist() == [1, 300, 2]
