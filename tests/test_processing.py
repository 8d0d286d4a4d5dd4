"""Batches from raw texts to risks, with a user's encoder, language model and classifier."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import authorship, marking, processing, similarity, training
from tessera.plans.base import CONFIG_JSON
from tests.test_candidates import batch_of_texts

PROSE = "The river ran past the old mill and the children threw stones off the bridge. Nobody in the village had seen such a winter before that year. Every house kept a lamp in the window until the snow was gone on the hills. "
OTHER = "Markets opened late because the letter of the capital had not arrived in time. Three merchants argued about the price of paper and of ink for hours. In the end the garden gate was shut and everyone went home without a word. "
CODE = "```py\ndef total(xs):\n    s = 0\n    for x in xs:\n        s += x\n    return s\n```\n"
RENAMED = CODE.replace("total", "summed").replace("xs", "values").replace("s +=", "acc +=").replace("s = 0", "acc = 0").replace("return s", "return acc")


@pytest.fixture
def submissions(spark):
    rows = [("b1", 1, "Student ID: A-12\n" + CODE + PROSE), ("b1", 2, RENAMED + PROSE + "One more line at the end."), ("b1", 3, OTHER), ("b1", 4, None), ("b1", 5, "  "), ("2024", 6, PROSE), ("2024", 7, OTHER)]
    return spark.createDataFrame(rows, "batch string, doc long, text string")


def test_process(spark, submissions, tmp_path):
    config = spark.createDataFrame([("b1", 100.0)], "batch string, total_marks double").withColumn("config", marking.parse_config(F.lit(CONFIG_JSON)))
    out = processing.process(submissions, str(tmp_path), batches=config)
    parsed = {r["doc"]: r for r in out["parsed"].collect()}
    assert parsed[1]["student_id"] == "A-12" and parsed[1]["has_code"] and not parsed[3]["has_code"]
    assert parsed[4]["status"] == parsed[5]["status"] == "parse_error" and parsed[4]["text"] is None
    pairs = {(r["a"], r["b"]): r for r in out["pairs"].collect()}
    assert set(pairs) == {(1, 2)} and pairs[1, 2]["fused"] > 0.8 and pairs[1, 2]["code_score"] == 1.0
    risks = {r["doc"]: r for r in out["risks"].collect()}
    assert set(risks) == {1, 2, 3, 6, 7} and risks[1]["weight_profile"] == "code_present" and risks[3]["text_sim_max"] == 0
    assert risks[1]["weighted_score"] > risks[3]["weighted_score"]
    assert {r["doc"] for r in out["marks"].collect()} == {1, 2, 3}

    # a run over one batch replaces that batch's rows only
    again = processing.process(submissions.where("doc in (6, 7)").withColumn("text", F.lit(PROSE)), str(tmp_path))
    assert {(r["a"], r["b"]) for r in again["pairs"].collect()} == {(6, 7)}
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 2 and spark.read.parquet(f"{tmp_path}/risks").count() == 5


def test_every_pair_agrees_with_the_exact_way(spark, submissions, tmp_path):
    got = {(r["a"], r["b"]): r["tfidf"] for r in processing.process(submissions, str(tmp_path), every_pair=True)["pairs"].collect()}
    texts = spark.read.parquet(f"{tmp_path}/parsed").where("text is not null").select("batch", "doc", "text")
    want = {(r["a"], r["b"]): r["tfidf"] for r in similarity.tfidf_pairs(similarity.tfidf_vectors(texts)).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3), (6, 7)}
    assert all(abs(got[p] - want.get(p, 0.0)) < 1e-12 for p in got)


def test_user_models(spark, submissions, tmp_path):
    @F.pandas_udf("array<float>")
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [1.0, float("mill" in t)])

    @F.pandas_udf("double")
    def perplexity(text: pd.Series) -> pd.Series:
        return text.map(lambda t: 20.0 + len(t) % 50)

    train = spark.createDataFrame([(i, i % 2, 20.0 + 40 * (i % 2) + i % 7, 5.0 + i % 3, 0.5) for i in range(40)], "doc long, y int, perplexity double, burstiness double, stylometric double")
    model = training.fit(train)
    external = spark.createDataFrame([(3, 1.0)], "doc long, api_score double")
    out = processing.process(submissions, str(tmp_path), encode=encode, model=authorship.ScoredBy(perplexity), classifier=model, external=external)
    assert out["pairs"].where("a = 1 and b = 2").first()["semantic"] == pytest.approx(1.0)
    results = {r["doc"]: r for r in out["results"].collect()}
    texts = {r["doc"]: r["text"] for r in out["parsed"].collect()}
    assert all(r["perplexity"] == 20.0 + len(texts[d]) % 50 for d, r in results.items())
    # the classifier decides where every signal is there, and the external score is averaged in
    local = {r["doc"]: r["ai_prob"] for r in authorship.probability(out["results"].select("doc", "perplexity", "burstiness", "stylometric"), model).collect()}
    p = {r["doc"]: r["probability"][1] for r in model.transform(out["results"].select("doc", "perplexity", "burstiness", "stylometric").dropna()).collect()}
    assert set(p) == {1, 2, 3, 6, 7} and all(local[d] == pytest.approx(p[d]) for d in p)
    assert results[3]["source"] == "fused" and results[3]["ai_prob"] == pytest.approx((local[3] + 1) / 2) and results[6]["source"] == "local"


def test_missing_signals_keep_the_heuristic(spark):
    train = spark.createDataFrame([(i, i % 2, 20.0 + 40 * (i % 2), 5.0 + i % 3, 0.5) for i in range(40)], "doc long, y int, perplexity double, burstiness double, stylometric double")
    rows = spark.createDataFrame([(1, None, None, 0.25), (2, None, None, None)], "doc long, perplexity double, burstiness double, stylometric double")
    got = {r["doc"]: r for r in authorship.probability(rows, training.fit(train)).collect()}
    assert got[1]["ai_prob"] == 0.25 and got[2]["ai_prob"] == 0.0 and got[1]["perplexity"] is None


def test_evidence(spark, submissions):
    docs = submissions.where("doc in (1, 2, 3)")
    pairs = spark.createDataFrame([("b1", 1, 2), ("b1", 1, 3)], "batch string, a long, b long")
    found = similarity.sentence_evidence(docs, pairs)
    got = found.collect()
    assert len(got) == 2 and {(r["a"], r["b"]) for r in got} == {(1, 2)}  # the first sentence of either text begins with its code
    assert all(r["sentence"] in PROSE.lower() for r in got)
    share = similarity.covered(found, docs).first()
    n = sum(len(r["sentence"]) for r in got)
    size = {r["doc"]: len(r["text"]) for r in docs.collect()}
    assert (share["share_a"], share["share_b"]) == (n / size[1], n / size[2])


def test_candidates_lose_no_pair(spark, tmp_path):
    """Pairs and risks of the candidates against those of every pair; a text inside another of fifty times its length is found."""
    docs = batch_of_texts(spark)
    some = processing.process(docs, f"{tmp_path}/some")
    every = processing.process(docs, f"{tmp_path}/every", every_pair=True)
    fused = {(r["a"], r["b"]): r["fused"] for r in every["pairs"].collect()}
    got = {(r["a"], r["b"]): r["fused"] for r in some["pairs"].collect()}
    assert len(got) < len(fused) and all(abs(got[p] - fused[p]) < 1e-12 for p in got)
    texts = {r["doc"]: r["text"] for r in docs.collect()}
    first = {t: min(i for i, u in texts.items() if u == t) for t in texts.values()}
    for least in (0.3, 0.5, 0.75):
        near = [p for p, v in fused.items() if v >= least]
        assert len(near) > 2 and all((a, b) in got for a, b in near if first[texts[a]] == a and first[texts[b]] in (a, b))
    assert (63, 64) in got and fused[63, 64] < 0.3
    risk = lambda out: {r["doc"]: (r["text_sim_max"], r["weighted_score"]) for r in out["risks"].collect()}
    a, b = risk(some), risk(every)
    assert set(a) == set(b) and all(a[d] == pytest.approx(b[d]) for d in b if b[d][0] >= 0.3)
    assert all(a[d][0] <= b[d][0] < 0.3 for d in b if b[d][0] < 0.3)


def test_near_pairs_and_maxima_come_from_tiles(spark):
    """The pairs of which one similarity reaches the threshold, and each document's greatest fused score, below the threshold, too; no pair is a row of a join."""
    docs = batch_of_texts(spark, n=30).select("batch", "doc", "text")
    weights, embeddings = similarity.tfidf_packed(docs).cache(), similarity.hashed_embeddings(docs, processing.DIMS).cache()
    found = processing.near(docs, weights, embeddings, 0.3)
    assert "(a#" not in found._jdf.queryExecution().executedPlan().toString()
    tfidf = {(r["a"], r["b"]): r["tfidf"] for r in similarity.tfidf_pairs(weights).collect()}
    semantic = {(r["a"], r["b"]): r["semantic"] for r in similarity.embedding_pairs(embeddings).collect()}
    ids = sorted(r["doc"] for r in docs.collect())
    fused = {(a, b): 0.4 * tfidf.get((a, b), 0.0) + 0.6 * semantic.get((a, b), 0.0) for a in ids for b in ids if a < b}
    rows = [r.asDict() for r in found.collect()]
    inside = {(r["a"], r["b"]) for r in similarity.containment_pairs(docs).collect()}
    got = {(r["a"], r["b"]): r["fused"] for r in rows if r["a"] != r["b"]}
    assert got.keys() == {p for p in fused if max(tfidf.get(p, 0.0), semantic.get(p, 0.0)) >= 0.3 or p in inside} and (33, 34) in inside and all(v == pytest.approx(fused[p]) for p, v in got.items())
    best = {d: max(r["fused"] for r in rows if r["a"] == r["b"] == d) for d in ids}
    assert best == pytest.approx({d: max(v for p, v in fused.items() if d in p) for d in ids}) and min(best.values()) < 0.3
