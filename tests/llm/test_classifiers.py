"""The classifiers against plain re-computation of features, scores, losses and steps."""

import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import labelled, quality, toxicity
from tessera.llm.words import scan

TEXTS = ["One two, TWO three", "", None, "ab", "日本語 テスト です", "naïve  café\n\tétude x", "a" * 3000, "she said he said", "é"]


def digest(raw: bytes) -> int:
    s = scan([raw.decode()], np.zeros(256, bool))
    return int(s.hash(np.array([0]), np.array([len(raw)]))[0])


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_quality_scores_and_features():
    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.normal(size=quality.BUCKETS) * 20, 0.3)
    got = model.score(TEXTS)
    for t, score, (f, n) in zip(TEXTS, got, quality.features(TEXTS)):
        u = re.sub(r"[\x20\x09-\x0D]", " ", lower(t)) + " "
        own = [(digest(w.encode()) ^ int(quality._SALT)) % quality.BUCKETS for w in u.split(" ") if w]
        own += [digest(u[i : i + k].encode()) % quality.BUCKETS for k in (3, 4, 5) for i in range(len(u) - k + 1) if " " not in u[i + 1 : i + k - 1]]
        z = np.mean([model.gain[x] for x in own]) + 0.3 if own else 0.3
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9
        assert dict(zip(f.tolist(), n.tolist())) == {x: own.count(x) for x in own}
    assert max(n.max() for _, n in quality.features(["b" * 200_000])) > 65535
    assert np.allclose(model.score(TEXTS[::-1])[::-1], got)  # whatever stands beside a text


def test_quality_step_follows_the_gradient():
    rows = [(1, np.array([3, 70, 900]), np.array([2, 1, 5], np.uint32))]
    dim, rate, seed = 4, 0.5, 3
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / dim, 1 / dim, (quality.BUCKETS, dim))
    w1 = rng.normal(0, 1, dim)
    w, b = np.stack([-w1, w1]), np.array([0.0, np.log(2 / 1)])
    share = np.array([2, 1, 5]) / 8

    def loss(own, w, b):
        z = w @ (share @ own) + b
        return np.log(np.exp(z).sum()) - z[1]

    def slope(x, f):
        out = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            out[i] = (f(up) - f(down)) / 2e-5
        return out

    own = v[rows[0][1]]
    dv, dw, db = slope(own, lambda x: loss(x, w, b)), slope(w, lambda x: loss(own, x, b)), slope(b, lambda x: loss(own, w, x))
    model = quality.QualityModel.fit(rows, dim=dim, epochs=1, rate=rate, seed=seed)
    v[rows[0][1]], w, b = own - rate * 8 * dv, w - rate * dw, b - rate * 0.1 * db
    assert np.allclose(model.gain, v @ (w[1] - w[0]), atol=1e-5) and abs(model.bias - (b[1] - b[0])) < 1e-5


def test_toxicity_scores_and_loss():
    rng = np.random.default_rng(5)
    words = ["tree", "river", "stone", "blurg", "zorkhead", "he", "she", "paper"]
    texts, y = [], []
    for i in range(200):
        bad = i % 3 == 0
        w = [words[j] for j in rng.integers(0, 3, 5)] + [["paper", "blurg"][bad] if rng.random() < 0.8 else "zorkhead", ["he", "she"][int(rng.random() < (0.8 if bad else 0.3))]]
        texts.append(" ".join(w))
        y.append(int(bad))
    sets = [toxicity._by_row(toxicity.features(ts), 200) for ts in (texts, [toxicity.swapped(t) for t in texts])]
    rows = [(label, a, np.setdiff1d(a, b), np.setdiff1d(b, a)) for label, a, b in zip(y, *sets)]
    keep = toxicity.features(["he", "she"])[1]
    model = toxicity.ToxicityModel.fit(rows, keep=keep.tolist())
    at = {int(f): int(i) for f, i in enumerate(model.slot) if i >= 0}
    for t in [*texts[:20], None, "", "She Zorkhead zorkhe"]:
        own = {(digest(w.encode()) ^ int(toxicity._SALT)) % toxicity.BUCKETS for w in lower(t).split()}
        own |= {digest(w.encode()[:n]) % toxicity.BUCKETS for w in lower(t).split() for n in toxicity.PREFIXES if len(w) > n}
        z = model.bias + sum(model.weight[at[x]] for x in own if x in at)
        assert abs(model.score([t])[0] - 1 / (1 + np.exp(-z))) < 1e-9
    x, d = np.zeros((200, len(at))), np.zeros((200, len(at)))
    for i, (_, own, lost, won) in enumerate(rows):
        for f in own:
            if int(f) in at:
                x[i, at[int(f)]] = 1
        for fs, sign in ((lost, 1), (won, -1)):
            for f in fs:
                if int(f) in at:
                    d[i, at[int(f)]] = sign
    d = d[np.abs(d).sum(axis=1) > 0]

    def loss(w, b):
        z = x @ w + b
        return (np.logaddexp(0, z) - np.array(y) * z).mean() + 1e-4 / 2 * (w @ w) + ((d @ w) ** 2).mean()

    w, b = np.zeros(len(at)), 0.0  # plain descent on the same loss
    for _ in range(6000):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.1 * (x.T @ err / 200 + 1e-4 * w + 2 * d.T @ (d @ w) / len(d)), b - 0.1 * err.mean()
    assert loss(model.weight, model.bias) < loss(w, b) + 0.01


def test_long_documents_are_passed_over_in_training(spark, make_docs):
    assert labelled.fitting([(1, 5), (2, 90), (3, 6), (4, 9)], 20) == [1, 3, 4]
    docs = make_docs([(i, "word " * (5000 if i == 3 else 4), "s") for i in range(12)] + [(5, "a again", "s")]).withColumns({"y": F.lit("z"), "h": F.lit(1), "quality": F.lit("q")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in labelled.training_rows(docs, labels, "quality", 100, 1000).collect()}
    free = {i for i in range(12) if i != 3} - {r["doc_id"] for r in docs.where(labelled.held_out("doc_id")).collect()}
    assert set(got) == free and all(r["y"] == 1 for r in got.values())
    if 5 in got:
        assert got[5]["text"] == "a again"


def test_empty_tables_repeats_and_clashing_columns(spark, make_docs):
    docs = make_docs([(1, "x y", "s"), (1, "x y", "s"), (None, "z", "s")]).withColumns({"score": F.lit("a"), "held_out": F.lit(1)})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for op in (quality, toxicity):
        model = op.train(docs, none)
        got = op.score_documents(docs, model).collect()
        assert len(got) == 3 and len({r["score"] for r in got}) == 1 and 0 <= got[0]["score"] <= 1
        assert op.score_documents(docs.limit(0), op.train(docs.limit(0), none)).count() == 0
