"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import pq, vafile


def vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 8))
    v[100:130] = v[0] + rng.normal(size=(30, 8)) * 0.12
    v[130:140] = v[1]
    rows = [(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)]
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [None] + [1.0] * 7, 0), (204, [1.0] * 8, None), (205, [1.0] * 3, 0), (206, [2.0] * 3, 0), (207, [], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_near_duplicates(spark):
    rows, df = vectors(spark)
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(good):
        for b in good[:i]:
            x, y = (np.array(np.array(r[1], np.float32), float) for r in (a, b))
            if a[2] == b[2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a[0]] += 1
                links[b[0]] += 1
                p, q = sorted((find(a[0]), find(b[0])))
                root[q] = p
    for sizes in ({}, {"list_size": 20, "part": 7}):
        got = pq.near_duplicates(df, 0.98, **sizes).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (links[i], find(i), find(i) == i) for i in links}
    assert sum(links.values()) > 100
    assert pq.near_duplicates(df.limit(0), 0.98).count() == 0


def best(v, q, k):
    return sorted((-sum(int(a) * int(b) for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:k]


def test_top_k(spark):
    rows, df = vectors(spark)
    own = vafile.quantised(df)
    v = {r["vec_id"]: np.array(r["v"]) for r in own.collect()}
    assert set(v) == set(range(150)) | {201, 204, 205, 206}
    assert all((v[i] == np.floor(256 * np.float32(rows[i][1]).astype(float))).all() for i in range(150))
    for sizes in ({}, {"bits": 3, "query_block": 11}):
        got = vafile.top_k(own, own.where("vec_id % 5 = 0"), 4, **sizes).collect()
        for q in (i for i in v if i % 5 == 0):
            assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best(v, q, 4)
    file = vafile.VAFile(own, 4)
    assert file.candidates(own.where("vec_id % 5 = 0")).count() < 0.2 * 31 * 150  # of all pairs
    assert vafile.top_k(own.limit(0), own.limit(0), 4).count() == 0


def test_top_k_of_large_components_ties_and_repeats(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 6)) * 10.0 ** rng.integers(0, 7, (60, 1))
    v[40:50] = v[3]  # ties, and repeats of a query
    v[50:53] = [[3e5, 4e5, 0, 0, 0, 0], [1e25] * 6, [-1e30, 1e30, 1, 1, 1, 1]]
    rows = [(i % 57, [float(x) for x in r], 0) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"uid": F.lit("x"), "v": F.lit(1), "dim": F.lit("z")})
    own = vafile.quantised(df)
    every = [(r["uid"], r["vec_id"], r["v"]) for r in own.collect()]
    got = vafile.top_k(own, own.where("vec_id % 2 = 0"), 5).collect()
    want = []
    for u, i, x in every:
        if i % 2 == 0:
            near = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), j) for w, j, y in every if w != u)[:5]
            want += [(i, n + 1, j, -s if -(2**63) <= -s < 2**63 else None) for n, (s, j) in enumerate(near)]
    assert sorted(map(str, want)) == sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in got)
    assert any(w[3] is None for w in want) and any(w[3] and abs(w[3]) > 2**54 for w in want)


def test_near_duplicates_of_repeats_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"uid": F.lit("x"), "node": F.lit(1), "cell": F.lit(2), "grp": F.lit("g")})
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in pq.near_duplicates(df).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]


def test_finite_vectors_of_any_size(spark):
    """Squares that overflow or vanish do not matter."""
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1e-200], 0), (4, [3.0, 3.1], 0), (5, [5e-324, 5e-324], 0), (6, [1.7e308, 1.7e308], 0), (7, [1e200, -1e200], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (5, 1) for i in range(1, 7)} | {7: (0, 7)}
