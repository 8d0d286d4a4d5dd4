"""That steps pass on no more rows than their results need."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import authorship, code, similarity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_words_are_no_rows(spark):
    """Pairs of words are dealt out by bucket, for texts of the model and others; none is a row of a join or an aggregation."""
    texts = ["a b a b c", "the a the b", "  ", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    asked = [*texts, "a z b", "<s> a"]
    model = authorship.BigramModel(docs)
    out = model.perplexity(spark.createDataFrame(list(enumerate(asked)), "doc long, text string"), ["doc"])
    assert "Join" not in plan(out).replace("BroadcastNestedLoopJoin", "") and "w1" not in plan(out)
    split = [t.split() for t in texts]
    pairs = lambda w: list(zip(["<s>", *w], w))
    n12 = Counter(p for w in split for p in pairs(w))
    n1 = Counter(p[0] for w in split for p in pairs(w))
    v = len({w for x in split for w in x})
    want = {i: math.exp(-sum(math.log((n12[p] + 0.5) / (n1[p[0]] + 0.5 * v)) for p in pairs(t.split())) / len(t.split())) for i, t in enumerate(asked) if t.split()}
    got = {r["doc"]: r["perplexity"] for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_risks_and_insights_expand_no_class(spark):
    """The maxima and counts over all pairs come from the links of classes; a crowd of copies is no pairs."""
    crowd = "This sentence is known to all of them. "
    texts = [crowd, crowd + "x", crowd + "Another one that some have too. ", crowd + "Another one that some have too. And more words stand here", "Nothing in common with any of them"]
    docs = spark.createDataFrame([("b", i, texts[i % 5], i % 3 == 0) for i in range(24)], "batch string, doc long, text string, has_code boolean")
    members, links = similarity.sentence_classes(docs)
    members = members.join(docs.select("doc", F.length("text").alias("n"), F.col("has_code").alias("c")), "doc").localCheckpoint()
    score = F.least(F.col("n_sentences"), F.lit(10)) / 10
    pairs = similarity.class_pairs(members, links).withColumns({"fused": F.least(F.lit(1.0), F.col("n_chars") / F.least("na", "nb")), "code": F.when(F.col("ca") & F.col("cb"), score).otherwise(0.0)})
    key = lambda df: sorted((r["doc"], r["text_sim_max"], r["code_sim_max"]) for r in df.collect())
    out = similarity.closest(members, links, score)
    assert key(out) == key(similarity.max_similarity(pairs, {"fused": "text_sim_max", "code": "code_sim_max"})) and len(key(out)) == 24
    assert links.count() < 10 < 100 < pairs.count()


def test_evidence_joins_common_sentences_only(spark):
    """A pair's texts meet in no row before the sentence that they share; without given pairs, all that share one are found."""
    docs = spark.createDataFrame([("b", i, f"Own sentence of number {i} here. All have this sentence here. " * 2) for i in range(4)], "batch string, doc long, text string")
    got = sorted((r["a"], r["b"], r["at_a"], r["at_b"], r["sentence"]) for r in similarity.sentence_evidence(docs).collect())
    assert got == [(i, j, 1, 1, "all have this sentence here") for i in range(4) for j in range(i + 1, 4)]
    some = spark.createDataFrame([("b", 0, 3)], "batch string, a long, b long")
    assert [(r["a"], r["b"]) for r in similarity.sentence_evidence(docs, some).collect()] == [(0, 3)]


def test_equal_patterns_are_scored_once(spark, monkeypatch):
    """Pairs whose tokens differ by name only take one search; the score is that of the tokens themselves."""
    import pyarrow as pa

    own = [[["def", "f", "(", str(i), ")"], ["x", str(i), "y"]] for i in range(6)]
    rows = pa.table({"doc": list(range(6)), "blocks": own})
    pairs = pa.table({"batch": ["b"] * 16, "a": [i for i in range(6) for j in range(i + 1, 6)] + [0], "b": [j for i in range(6) for j in range(i + 1, 6)] + [9]})
    taken, best = [], code.best_ratio
    monkeypatch.setattr(code, "best_ratio", lambda x, y: (taken.append(1), best(x, y))[1])
    code._of_pattern.cache_clear()
    got = code._cell_scores(True)(pairs, rows).to_pylist()
    assert len(taken) == 1 and got[-1]["code_score"] == 0.0
    assert all(r["code_score"] == best(own[r["a"]], own[r["b"]])[0] for r in got[:-1])
    assert len(code._cell_scores(False)(pairs, rows)) == 15


def test_shingles_are_no_rows(spark):
    """Signatures are taken where the text is read: no shingle is a row of an aggregation. Rows of one document are combined."""
    import hashlib

    texts = {0: "one two three two three", 1: "", 2: "alone", 3: " ".join(f"w{i % 1500}x{i}" for i in range(3000)), 4: "ONE  Two\tthree"}
    rows = [("b", i, t) for i, t in texts.items()] + [("b", 4, "four five"), ("b", 5, None)]
    signed = similarity.minhash_signatures(spark.createDataFrame(rows, "batch string, doc long, text string"))
    assert "Generate" not in plan(signed)
    got = {r["doc"]: r["signature"] for r in signed.collect()}
    grams = lambda t: {" ".join(p) for p in zip(t.split(), t.split()[1:])} or {t.strip()}
    sets = {i: grams(t.lower()) for i, t in texts.items()} | {4: {"one two", "two three", "four five"}}
    x = {i: [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in s] for i, s in sets.items()}
    assert got == {i: [min((a * v + b) % similarity.MERSENNE for v in x[i]) for _, a, b in similarity.permutations()] for i in sets}


def test_pairs_are_fitted_without_their_texts(spark):
    """Vectors fitted for each pair alone, with the cut to the most frequent terms, against plain Python; no text is a row for each of its pairs."""
    import random

    from tessera.operators import products

    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(2, 60))) for _ in range(14)] + ["", "alone"]
    docs = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "batch string, doc long, text string")
    pairs = spark.createDataFrame([("b", i, j) for i in range(16) for j in range(i + 1, 16)], "batch string, a long, b long")
    counts = similarity.term_counts(docs)
    tf = {r["doc"]: dict(zip(r["term"], r["tf"])) for r in counts.collect()}
    assert tf == {i: dict(Counter(t.split()) + Counter(map(" ".join, zip(t.split(), t.split()[1:])))) for i, t in enumerate(texts)}
    for most in (7, 10_000):
        want = {}
        for i, j in ((i, j) for i in tf for j in tf if i < j):
            cf = Counter(tf[i]) + Counter(tf[j])
            kept = set(sorted(cf, key=lambda t: (-cf[t], t))[:most])
            x, y = ({t: (1 + math.log(n)) * (math.log(3 / (1 + (t in tf[i]) + (t in tf[j]))) + 1) for t, n in tf[k].items() if t in kept} for k in (i, j))
            if set(x) & set(y):
                want[i, j] = sum(x[t] * y[t] for t in set(x) & set(y)) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        out = products.fitted_to_pairs(counts, pairs, most, block=4)
        got = {(r["a"], r["b"]): r["tfidf"] for r in out.collect()}
        assert "Generate explode(term" not in plan(out) and got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_greatest_products_make_no_pair(spark):
    """Each document's greatest product comes from the cells; pairs are no rows."""
    from tessera.operators import products

    docs = spark.createDataFrame([("b" if i % 5 else "c", i, " ".join(f"w{(i * j) % 23}" for j in range(i % 7 + 1))) for i in range(1, 40)] + [("b", 99, "lonely word")], "batch string, doc long, text string")
    packed = products.sparse(similarity.tfidf_vectors(docs)).localCheckpoint()
    want = similarity.max_similarity(products.all_pairs(packed), {"value": "value"}).collect()
    for block in (4, 2048):
        out = products.greatest(packed, block=block)
        assert "Union" not in plan(out)
        assert sorted((r["doc"], round(r["value"], 9)) for r in out.collect()) == sorted((r["doc"], round(r["value"], 9)) for r in want)


def test_lines_are_joined_without_a_shuffle_by_batch(spark):
    """A line is shuffled by no batch, and the pairs of a class's members come after the joins of links."""
    from tessera.sources import io

    batches = spark.createDataFrame([("b", "Batch b"), ("c", "Batch c")], "batch string, name string")
    docs = spark.createDataFrame([("b", i, f"S{i}") for i in range(6)], "batch string, doc long, student_id string")
    risks = spark.createDataFrame([(i, 0.5, "medium", 0.5, None, "theory_only") for i in range(5)], "doc long, weighted_score double, risk_level string, text_sim_max double, code_sim_max double, weight_profile string")
    ai = spark.createDataFrame([(i, 0.5, "local") for i in range(6)], "doc long, ai_prob double, source string")
    members = spark.createDataFrame([("b", i, i // 3 * 3, 3) for i in range(6)], "batch string, doc long, class long, size long")
    links = spark.createDataFrame([("b", 0, 3, 1, 30), ("b", 0, 0, 2, 50)], "batch string, a long, b long, n_sentences long, n_chars long")
    pairs = similarity.class_pairs(members, links)
    assert sorted((r["a"], r["b"], r["n_chars"]) for r in pairs.collect()) == sorted([(i, j, 30) for i in range(3) for j in range(3, 6)] + [(0, 1, 50), (0, 2, 50), (1, 2, 50)])
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the planner knows no sizes
    try:
        lines = io.document_lines(batches, docs, risks, ai, pairs.withColumns({"fused": F.lit(0.5), "copy_direction": F.lit("mutual")}))
        assert not [x for x in plan(lines).splitlines() if "SortMergeJoin [batch#" in x and "], [batch#" in x and "a#" not in x and "b#" not in x.replace("batch#", "")]
        got = Counter((r["batch"], r["part"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert got == {("b", 0): 1, ("b", 1): 6, ("b", 2): 1, ("b", 3): 12, ("b", 4): 1, ("c", 0): 1, ("c", 2): 1, ("c", 4): 1}


def test_matrix_by_cells_and_rows(spark):
    """Every cell of a batch's matrix from cells of blocks, and its rows one by one; a batch is no single row and its grid is in no join."""
    from tessera.operators import products, results

    docs = spark.createDataFrame([("b", 7 * i % 30, f"S{i}") for i in range(30)] + [("c", 50, "T")], "batch string, doc long, label string")
    score = {(i, j): (i + j) / 100 for i in range(30) for j in range(i + 1, 30) if i * j % 3 == 1}
    pairs = spark.createDataFrame([("b", *p, s) for p, s in score.items()], "batch string, a long, b long, fused double")
    name = {r["doc"]: r["label"] for r in docs.collect()}
    want = {("b", name[i], name[j]): 1.0 if i == j else score.get((min(i, j), max(i, j)), 0.0) for i in range(30) for j in range(30)} | {("c", "T", "T"): 1.0}
    for block in (7, 512):
        got = products.grid(docs, pairs.withColumnRenamed("fused", "score"), block=block).collect()
        assert len(got) == len(want) and {(r["batch"], r["row_label"], r["col_label"]): r["score"] for r in got} == want
    rows = results.matrix_rows(docs, pairs, F.col("label")).collect()
    order = {b: sorted(r["label"] for r in rows if r["batch"] == b) for b in "bc"}
    assert len(rows) == 31 and all(r["row"] == [want[r["batch"], r["label"], c] for c in order[r["batch"]]] and order[r["batch"]][r["i"] - 1] == r["label"] for r in rows)
    assert {(r["batch"], r["i"]) for r in results.matrix_rows(docs, pairs, F.col("label"), F.col("i") == 1).collect()} == {("b", 1), ("c", 1)}


def test_pairs_of_buckets_are_no_rows_before_they_are_results(spark, monkeypatch):
    """Candidates are those of buckets split step by step, each once; no pair is joined or compared with other pairs, in one cell or several."""
    import random

    rng = random.Random(4)
    signed = {i: [rng.randrange(3) for _ in range(8)] + [rng.randrange(40) for _ in range(120)] for i in range(90)} | {90: [0] * 128, 91: [0] * 128, 92: [0] * 4 + [1] * 124}
    most, want, stack = 6, set(), [(band, 4, list(range(91)) + [92]) for band in range(32)]
    while stack:
        band, n, members = stack.pop()
        buckets = {}
        for i in members:
            buckets.setdefault(tuple((signed[i] * 2)[band * 4 : band * 4 + n]), []).append(i)
        for own in buckets.values():
            if len(own) <= most:
                want |= {(x, y) for x in own for y in own if x < y}
            else:
                want |= {(min(own), y) for y in own if y != min(own)}
                stack += [(band, 2 * n, own)] if n < 128 else []
    signatures = spark.createDataFrame([(b, i, s) for b in "xy" for i, s in signed.items()], "batch string, doc long, signature array<long>")
    for cell, held in ((4096, 1 << 19), (20, 5)):
        monkeypatch.setattr(similarity, "CELL", cell)
        monkeypatch.setattr(similarity, "PAIRS", held)
        found = similarity.lsh_candidates(signatures, most=most)
        assert "a#" not in "".join(line for line in plan(found).splitlines() if "Aggregate" in line) and "(a#" not in plan(found)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {(b, x, y) for b in "xy" for x, y in want | {(90, 91)}}
