"""That pairs of a batch are made in tiles, where their vectors are, and are no rows before their results."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import products, results, similarity, training
from tessera.params import TfidfParams
from tessera.plans import base, similarity_plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = [" ".join(f"w{(i * j) % 23}" for j in range(i % 9)) for i in range(1, 40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("b" if i % 5 else "c", i, t) for i, t in enumerate(TEXTS)], "batch string, doc long, text string").localCheckpoint()


@pytest.fixture(scope="module")
def packed(docs):
    return similarity.tfidf_packed(docs).localCheckpoint()


def test_weights_are_fitted_without_rows_of_terms(spark):
    """Against plain Python, with the cut to the most frequent terms; rows of one document are one."""
    rows = [("b", 1, "x y x"), ("b", 1, "z y"), ("b", 2, "y z q"), ("b", 3, ""), ("c", 4, "lone")]
    docs = spark.createDataFrame([(b, d, " ".join(w * 2 for w in t.split())) for b, d, t in rows], "batch string, doc long, text string")
    tf = defaultdict(Counter)
    for b, d, t in docs.collect():
        w = t.split()
        tf[b, d] += Counter(w) + Counter(map(" ".join, zip(w, w[1:])))
    for most in (3, 10_000):
        out = similarity.tfidf_packed(docs, TfidfParams(max_terms=most))
        want = {}
        for b, n in (("b", 4), ("c", 1)):
            own = {d: c for (x, d), c in tf.items() if x == b}
            cf, df = sum(own.values(), Counter()), Counter(t for c in own.values() for t in c)
            kept = set(sorted(cf, key=lambda t: (-cf[t], t))[:most])
            for d, c in own.items():
                v = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items() if t in kept}
                if v:
                    want[b, d] = {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
        got = {(r["batch"], r["doc"]): dict(zip(r["term"], r["weight"])) for r in out.collect()}
        assert got.keys() == want.keys() and all(got[k].keys() == want[k].keys() and all(math.isclose(got[k][t], want[k][t]) for t in want[k]) for k in want)
        assert "Generate" not in plan(out).split("FlatMapCoGroupsInArrow")[1].split("Sort")[1] and "Window" not in plan(out).split("FlatMapCoGroupsInArrow")[0]


def test_vectors_go_to_few_cells(spark, packed):
    """However many tiles a batch has, its vectors are in few cells."""
    own = packed.select("batch", "doc", "at", "weight")
    cells = products._by_cell(own, 2)._df
    assert max(r["count"] for r in cells.groupBy("batch", "doc").count().collect()) == products.WAYS < packed.where("batch = 'b'").count() / 2
    embeddings = spark.createDataFrame([("b", i, [1.0 + i, float(i % 3), 2.0]) for i in range(30)], "batch string, doc long, embedding array<double>")
    one = {tuple(r) for r in similarity.embedding_pairs(embeddings).withColumn("semantic", F.round("semantic", 9)).collect()}
    small = products.all_pairs(products.dense(embeddings), block=2).withColumn("value", F.round("value", 9)).collect()
    assert {tuple(r) for r in small} == one and len(small) == 435


def test_threshold_makes_no_candidates(packed):
    """What reaches the threshold comes from the tiles; no candidate is a row of a join."""
    out = similarity.threshold_pairs(packed, 0.3)
    assert plan(out).count("Join") == 1 and "SortMergeJoin" not in plan(out)  # that with the numbers of blocks
    want = {(r["a"], r["b"]) for r in similarity.tfidf_pairs(packed).collect() if r["tfidf"] >= 0.3}
    assert want and {(r["a"], r["b"]) for r in out.collect()} == want


def test_all_scores_without_a_join_of_pairs(docs, packed):
    rows = lambda df: sorted((r["batch"], r["a"], r["b"], round(r["fused"], 9), r["copy_direction"]) for r in df.collect())
    out = similarity.score_all_pairs(docs, packed)
    assert "Join" not in plan(out).split("FlatMapGroupsInArrow")[0]
    assert rows(out) == rows(similarity.score_pairs(docs, similarity.tfidf_pairs(packed))) and len(rows(out)) > 400


@pytest.fixture(scope="module")
def crowd(spark):
    lines = ["This sentence is known to all of them. ", "Another one that some have too. ", "And a third, which is rarer than that. "]
    rows = [("b" if i < 50 else "c", i, "".join(x for k, x in enumerate(lines) if i % (k + 2) != 1) + f"own words {i} " * (i % 4), i % 3 == 0, f"S{i}") for i in range(60)]
    return spark.createDataFrame(rows, "batch string, doc long, text string, has_code boolean, student_id string").localCheckpoint()


def linked(docs):
    """The pairs that share sentences, one by one, with scores."""
    members, links = similarity.sentence_classes(docs)
    pairs = similarity.class_pairs(members.join(docs.select("doc", F.length("text").alias("n"), F.col("has_code").alias("c")), "doc"), links)
    fused = F.round(F.least(F.lit(1.0), F.col("n_chars") / F.least("na", "nb")), 4)
    return pairs.withColumns({"fused": fused, "code_score": F.when(F.col("ca") & F.col("cb"), F.least(F.col("n_sentences"), F.lit(10)) / 10).otherwise(0.0)})


@pytest.mark.parametrize("size", [4, 16])
def test_tiles_are_added_up_where_they_are_made(crowd, size):
    out = results.tile_totals(crowd, ["student_id"], size)
    assert "Aggregate" not in plan(out).split("FlatMapGroupsInArrow")[0]
    want = results.heatmap_tiles(crowd, linked(crowd), ["student_id"], size).collect()
    got = {(r["batch"], r["tile_row"], r["tile_col"]): (r["n"], round(r["total"], 6)) for r in out.collect()}
    assert got == {(r["batch"], r["tile_row"], r["tile_col"]): (len(r["cells"]), round(sum(c["score"] for c in r["cells"]), 6)) for r in want} and len(got) > 3


def test_means_are_taken_where_pairs_are_found(crowd):
    vectors = {"_s": similarity.sentence_vectors(crowd), "_t": similarity.tfidf_packed(crowd), "_e": products.dense(similarity.hashed_embeddings(crowd))}
    out = training.shared_means(similarity.with_vectors(crowd.select("batch", "doc", F.length("text").alias("n"), F.col("has_code").alias("c")), vectors))
    pairs = linked(crowd).withColumn("class", F.when(F.col("fused") >= 0.7, "verbatim").when(F.col("fused") >= 0.4, "paraphrase").otherwise("unrelated"))
    of = pairs.select("batch", "a", "b")
    both = pairs.join(similarity.tfidf_of_pairs(similarity.tfidf_vectors(crowd), of), ["batch", "a", "b"], "left").join(similarity.embedding_pairs(similarity.hashed_embeddings(crowd), of), ["batch", "a", "b"])
    columns = ["fused", "code_score", "tfidf", "semantic"]
    rows = lambda df: sorted((r["class"], r["n"], *(round(r[c], 9) for c in columns)) for r in df.collect())
    assert rows(out) == rows(training.class_means(both.fillna(0.0, "tfidf"), columns)) and len(rows(out)) > 1
    assert "Join" not in plan(out).split("FlatMapGroupsInArrow")[0]


def test_grid_sums_beyond_a_bigint(spark, monkeypatch):
    """A check sum that no BIGINT holds is whole, as a decimal; others are BIGINTs, as in the SQL."""
    for big, kind in ((3_000_000_000, "decimal(38,0)"), (1000, "bigint")):
        rows = spark.createDataFrame([("b", big + i) for i in range(4)], "batch string, doc long")
        monkeypatch.setattr(base, "docs", lambda s, d: rows)  # noqa: B023
        out = similarity_plans.Q["c6_pair_grid"](spark, "")
        want = sum((big + i) * (big + j) for i in range(4) for j in range(i + 1, 4))
        assert [(r["n"], int(r["check_sum"])) for r in out.collect()] == [(6, want)] and dict(out.dtypes)["check_sum"] == kind
