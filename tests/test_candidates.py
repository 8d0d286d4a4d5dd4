"""Pairs that are scored come from the texts, however far apart their ids are."""

import random

from pyspark.sql import functions as F

from tessera.operators import products, similarity
from tessera.plans import registry

WORDS = ["river", "stone", "paper", "cloud", "house", "light", "green", "table", "winter", "market", "letter", "garden"]


def corpus(spark, folder):
    """Copies with one word changed, more than 100 ids apart, whose ids are multiples of no common number."""
    rng = random.Random(5)
    text = [" ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(120)) for _ in range(4)]
    rows = [(7 + i, t, "src1") for i, t in enumerate(text)]
    rows += [(901 + 13 * i, t + " ending", "src1") for i, t in enumerate(text)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return {(7 + i, 901 + 13 * i) for i in range(4)}


def test_far_pairs_are_scored(spark, tmp_path):
    want = corpus(spark, str(tmp_path))
    for name, score in (("c11_lexical_overlap", "lexical"), ("c11_word_jaccard", "jaccard"), ("c12_candidates_tfidf", "tfidf")):
        got = {(r["a"], r["b"]): r[score] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert set(got) == want and all(x > 0.9 for x in got.values()), name


def test_code_pairs(spark, tmp_path):
    corpus(spark, str(tmp_path))
    got = {(r["a"], r["b"]): r["code_score"] for r in registry.queries()["d3_d5_code_score"](spark, str(tmp_path)).collect()}
    assert any(b - a > 100 for a, b in got) and all(x > 0.5 for x in got.values())


def test_recall_of_signature_bands(spark):
    """Candidates and estimates against exact Jaccard similarity of two-word shingles, at many degrees of change."""
    rng = random.Random(8)
    word = lambda: rng.choice(WORDS) + str(rng.randrange(400))
    texts = []
    for i in range(60):
        base = [word() for _ in range(150)]
        texts.append(base)
        for share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3):
            texts.append([word() if rng.random() < share else w for w in base])
    sets = [set(zip(t, t[1:])) for t in texts]
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a // 7 * 7 + 7) if a < b}
    docs = spark.createDataFrame([("x", i, " ".join(t)) for i, t in enumerate(texts)], "batch string, doc long, text string")
    signatures = similarity.minhash_signatures(docs).cache()
    found = {(r["a"], r["b"]) for r in similarity.lsh_candidates(signatures).collect()}
    near = [p for p, j in exact.items() if j >= 0.6]
    values = {r["doc"]: r["signature"] for r in signatures.collect()}
    first = {}  # documents of equal signature are represented by the smallest
    for i in sorted(values):
        first.setdefault(tuple(values[i]), i)
    stands = {i: first[tuple(values[i])] for i in values}
    recall = sum(stands[a] == stands[b] or tuple(sorted((stands[a], stands[b]))) in found for a, b in near) / len(near)
    errors = [sum(x == y for x, y in zip(values[a], values[b])) / 128 - exact[a, b] for a, b in exact]
    print("recall", recall, len(near), "mean error", sum(errors) / len(errors), "root of mean square", (sum(e * e for e in errors) / len(errors)) ** 0.5)
    expected = sum(1 - (1 - exact[p] ** 4) ** 32 for p in near) / len(near)
    print("expected", expected)
    assert len(near) > 150 and recall >= expected - 0.02
    assert abs(sum(errors) / len(errors)) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06
    assert len([p for p in found if p not in exact]) < 20  # of unlike texts


def batch_of_texts(spark, n=60, seed=9):
    """Unlike texts over a common vocabulary, some with much in common, exact copies, and one text inside another of fifty times its length."""
    rng = random.Random(seed)
    common = [w + str(i) for w in WORDS for i in range(3)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "x" + str(rng.randrange(5000))
    texts = [[word() for _ in range(80)] for _ in range(n)]
    for i in range(0, n // 2, 3):
        keep = rng.random()
        texts[i + 1] = [w if rng.random() < keep else word() for w in texts[i]]
    texts += [texts[0], texts[0], texts[7]]
    part = ["quoted" + str(i) for i in range(40)]
    texts += [part, [word() for _ in range(1000)] + part + [word() for _ in range(1000)]]
    return spark.createDataFrame([("x" if i < 50 else "y", i, " ".join(t)) for i, t in enumerate(texts)], "batch string, doc long, text string").withColumn("batch", F.lit("x"))


def test_threshold_pairs_are_exact(spark):
    vectors = similarity.tfidf_vectors(batch_of_texts(spark)).cache()
    every = {(r["a"], r["b"]): r["tfidf"] for r in similarity.tfidf_pairs(vectors, blocks=False).collect()}
    for block in (7, 256):
        packed = products.sparse(vectors)
        blocks = {(r["a"], r["b"]): r["value"] for r in products.all_pairs(packed, block=block).collect()}
        assert set(blocks) == set(every) and all(abs(blocks[p] - every[p]) < 1e-12 for p in every)
        some = [("x", a, b) for a, b in list(every)[::3]]
        given = {(r["a"], r["b"]): r["value"] for r in products.of_pairs(packed, spark.createDataFrame(some, "batch string, a long, b long"), block=block).collect()}
        assert set(given) == {p[1:] for p in some} and all(abs(given[p] - every[p]) < 1e-12 for p in given)
    for least in (0.1, 0.3, 0.5, 0.75, 1.0):
        want = {p for p, v in every.items() if v >= least - 1e-9}
        candidates = {(r["a"], r["b"]) for r in similarity.threshold_candidates(vectors, least).collect()}
        got = {(r["a"], r["b"]): r["tfidf"] for r in similarity.threshold_pairs(vectors, least).collect()}
        assert set(got) == want <= candidates and len(want) > 1
    assert len(candidates) < len(every) / 10


def test_containment(spark):
    docs = batch_of_texts(spark)
    texts = {r["doc"]: r["text"].split() for r in docs.collect()}
    grams = {i: set(zip(t, t[1:], t[2:])) for i, t in texts.items()}
    for least in (0.5, 0.8, 1.0):
        want = {}
        for a in grams:
            for b in grams:
                if a < b and len(grams[a] & grams[b]) >= least * min(len(grams[a]), len(grams[b])) - 1e-9:
                    want[a, b] = len(grams[a] & grams[b]) / min(len(grams[a]), len(grams[b]))
        got = {(r["a"], r["b"]): r["contained"] for r in similarity.containment_pairs(docs, least).collect()}
        assert got == want and (63, 64) in got and len(texts[64]) > 50 * len(texts[63])


def test_embeddings_by_blocks(spark):
    rng = random.Random(2)
    rows = [("x" if i % 3 else "y", i, [rng.gauss(0, 1) for _ in range(5 + i % 2)]) for i in range(50)]
    rows += [("x", 50, None), ("x", 51, []), ("x", 52, [0.0] * 5), ("x", 53, [float("nan")] * 5), ("x", 54, [1.0, None, 0.0, 0.0, 0.0]), ("x", 55, [1e200] * 5), ("x", 56, [1e-200] * 5)]
    vectors = spark.createDataFrame(rows, "batch string, doc long, embedding array<double>")

    def cosine(p, q):
        if not p or not q or len(p) != len(q) or any(x is None or x != x for x in [*p, *q]):
            return 0.0
        p, q = ([x / max(map(abs, v)) if any(v) else 0.0 for x in v] for v in (p, q))
        norm = (sum(x * x for x in p) * sum(x * x for x in q)) ** 0.5
        return sum(x * y for x, y in zip(p, q)) / norm if norm else 0.0

    want = {(i, j): cosine(p, q) for b, i, p in rows for c, j, q in rows if b == c and i < j}
    assert want[55, 56] > 1 - 1e-12
    pairs = spark.createDataFrame([("y" if i % 3 == 0 and i < 50 else "x", i, j) for i, j in want], "batch string, a long, b long")
    for found in (similarity.embedding_pairs(vectors), similarity.embedding_pairs(vectors, pairs)):
        got = {(r["a"], r["b"]): r["semantic"] for r in found.collect()}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    close = {(r["a"], r["b"]) for r in similarity.embedding_pairs(vectors, least=0.5).collect()}
    assert close == {p for p, v in want.items() if v >= 0.5}


def test_a_large_bucket_is_split(spark):
    """Documents that agree in one band only are a star; groups that agree in more rows are still paired; rows stay in proportion."""
    rng = random.Random(1)
    n, rows = 10_000, []
    for i in range(n):
        group = random.Random(i // 5)
        signature = [7] * 4 + [group.randrange(10**6) for _ in range(60)] + [rng.randrange(10**6) for _ in range(64)]
        rows.append(("x", i, signature))
    found = similarity.lsh_candidates(spark.createDataFrame(rows, "batch string, doc long, signature array<long>"), most=200).select("a", "b").collect()
    pairs = {(r["a"], r["b"]) for r in found}
    assert len(pairs) == len(found) < 6 * n
    assert all((i, j) in pairs for g in range(0, n, 5) for i in range(g, g + 5) for j in range(i + 1, g + 5))
    seen = {x for p in pairs for x in p}
    assert len(seen) == n and sum(a == 0 for a, _ in pairs) == n - 1


def test_a_common_sentence_makes_classes(spark):
    """A crowd with one sentence in common is a class and one link; the pairs stay available."""
    shared, other = "This sentence stands in every text of the crowd.", "And this one only in some of them, as it happens."
    rows = [("x", i, f"{shared} Number {i} has words of its own {i}." + (f" {other}" if i % 100 == 0 else "")) for i in range(10_000)]
    members, links = similarity.sentence_classes(spark.createDataFrame(rows, "batch string, doc long, text string"))
    assert members.count() == 10_000
    n = len(shared) - 1, len(shared) + len(other) - 2
    assert {tuple(r) for r in links.collect()} == {("x", 0, 0, 2, n[1]), ("x", 0, 1, 1, n[0]), ("x", 1, 1, 1, n[0])}
    few = spark.createDataFrame([r for r in rows if r[1] < 3 or r[1] in (100, 200)], "batch string, doc long, text string")
    got = {(r["a"], r["b"]): (r["n_sentences"], r["n_chars"]) for r in similarity.matched_sentences(few).collect()}
    ids = [0, 1, 2, 100, 200]
    assert got == {(a, b): (2, n[1]) if a % 100 == b % 100 == 0 else (1, n[0]) for a in ids for b in ids if a < b}
