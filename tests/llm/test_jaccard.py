"""Components against brute force, with copies, near copies, short, empty and null texts."""

import random
import re

from tessera.llm.jaccard import JaccardJoin


def brute(rows):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((r[0], len(s), rows[find(i)][0]) for i, (r, s) in enumerate(zip(rows, sets)))


def test_against_brute_force(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "One two", "one  TWO", "one two three"]
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(60):  # near copies of one text, some beyond the threshold
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 20 + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    texts += [" ".join(base[:k]) for k in range(40, 60)] + ["x " * 4000 + " ".join(base)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = JaccardJoin(slot_bits=12).components(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_empty_table_clashing_columns_and_repeats(spark, make_docs):
    assert JaccardJoin(slot_bits=12).components(make_docs([])).count() == 0
    from pyspark.sql import functions as F

    docs = make_docs([(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (7, "q", "s")]).withColumns({"cls": F.lit("z"), "n": F.lit(1), "component_id": F.lit(2)})
    got = JaccardJoin(slot_bits=12).components(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 1), (1, 1), (1, 1), (7, 7)]


def test_one_id_with_several_texts(spark, make_docs):
    rng = random.Random(3)
    x, y, z = (" ".join(rng.choice("abcdefghijk") * 3 + str(rng.randrange(99)) for _ in range(80)) for _ in range(3))
    docs = make_docs([(5, x, "s"), (5, y, "s"), (1, x, "s"), (8, y + " end", "s"), (9, z, "s"), (5, "", "s"), (2, "", "s")])
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in JaccardJoin(slot_bits=12).components(docs).collect())
    assert got == [(1, 1, 76), (2, 2, 0), (5, 1, 76), (5, 1, 76), (5, 5, 0), (8, 1, 77), (9, 9, 76)]
