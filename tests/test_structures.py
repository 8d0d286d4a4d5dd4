"""Syntax trees, bounds on ratios, exports line by line, tiles, curves and the registry of models."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration, code, results, training
from tessera.sources import io

ONE = "def total(xs, start=0):\n    s = start\n    for x in xs:\n        s += x * 2\n    return s\n\n\ndef show(v):\n    print('value', v)\n"
MOVED = "def show(thing):\n    print('value', thing)\n\n\ndef summed(values, first=0):\n    acc = first\n    for item in values:\n        acc += item * 2\n    return acc\n"
OTHER = "class Box:\n    def __init__(self):\n        self.items = {}\n\n    def get(self, k):\n        with open(k) as f:\n            return [line for line in f if line]\n"


def test_syntax_tokens(spark):
    renamed = ONE.replace("total", "t").replace("xs", "ys").replace("show", "put")
    assert code.syntax_tokens(ONE) == code.syntax_tokens(renamed) != code.syntax_tokens(ONE.replace("* 2", "* 3"))
    assert code.syntax_tokens(ONE) != code.syntax_tokens(MOVED) and code.syntax_tokens(ONE, ordered=False) == code.syntax_tokens(MOVED, ordered=False)
    assert code.syntax_tokens("def f(:") is None and code.syntax_tokens("\0") is None and code.syntax_tokens("x = " + "(" * 5000) is None
    assert code.syntax_tokens("") == ["Module"] and "var0" in code.syntax_tokens("import os as x")
    broken, c = ONE + "def broken(:\n", "#include <stdio.h>\nint main() { return 0; }"
    rows = spark.createDataFrame([(1, ONE), (2, MOVED), (3, broken), (4, c), (5, None), (6, "")], "i int, block string")
    tree = {r["i"]: r["t"] for r in code.code_tokens(rows, "block", "t", mode="ast", ordered=False).collect()}
    lexer = {r["i"]: r["t"] for r in code.code_tokens(rows, "block", "t").collect()}
    assert tree[1] == tree[2] and "FunctionDef" in tree[1] and lexer[1] != lexer[2]
    assert all(tree[i] == lexer[i] for i in (3, 4, 5)) and lexer[5] == []
    with pytest.raises(ValueError, match="mode"):
        code.code_tokens(rows, "block", "t", mode="x")


def test_blocks_by_bound(spark):
    """The same scores as all ratios, with few of them computed."""
    rng = random.Random(5)
    words = [chr(97 + i) for i in range(26)]
    base = [[rng.choice(words[i % 3 * 8 : i % 3 * 8 + 10]) for _ in range(60)] for i in range(12)]
    change = lambda t: [rng.choice(words) if rng.random() < 0.1 else w for w in t]
    tried = total = 0
    for _ in range(30):
        left, right = [change(rng.choice(base)) for _ in range(6)], [change(rng.choice(base)) for _ in range(6)]
        best, n, every = code.best_ratio(left, right)
        assert best == max(difflib.SequenceMatcher(None, x, y).ratio() for x in left for y in right)
        tried, total = tried + n, total + every
    print("ratios computed", tried, "of", total)
    assert tried < total / 4
    assert code.best_ratio([["a"]], [["a"]]) == (1.0, 1, 1) and code.best_ratio([["a"]], [["b"]])[0] == 0.0
    rows = spark.createDataFrame([("x", 1, [ONE, ONE, OTHER]), ("x", 2, [MOVED]), ("x", 3, [OTHER])], "batch string, doc long, blocks array<string>")
    pairs = spark.createDataFrame([("x", 1, 2), ("x", 1, 3), ("x", 1, 9)], "batch string, a long, b long")
    got = {(r["a"], r["b"]): (r["code_score"], r["n_tried"], r["n_ratios"]) for r in code.block_scores(pairs, code.block_rows(rows)).collect()}
    assert set(got) == {(1, 2), (1, 3)} and got[1, 3] == (1.0, 1, 2)


def test_documents_line_by_line(spark, tmp_path):
    """A batch's files in order are its document, the one that the nested row has; a large batch is several files."""
    batches = spark.createDataFrame([("b/1", 'name "x"', 1.5), ("b2", "é\n", None), ("none", "n", 0.0)], "batch string, name string, total double")
    docs = spark.createDataFrame([("b/1" if i % 3 else "b2", i, None if i % 7 == 0 else f"S{i}") for i in range(200)], "batch string, doc long, student_id string")
    risks = spark.createDataFrame([(i, i / 300, "low", 0.1, None, "theory_only") for i in range(0, 200, 2)], "doc long, weighted_score double, risk_level string, text_sim_max double, code_sim_max double, weight_profile string")
    ai = spark.createDataFrame([(i, 0.25, "local") for i in range(0, 200, 3)], "doc long, ai_prob double, source string")
    pairs = spark.createDataFrame([("b/1", a, b, a / 500, "mutual") for a in range(1, 60) for b in range(a + 1, 60) if a % 3 and b % 3], "batch string, a long, b long, fused double, copy_direction string")
    io.write_documents(io.document_lines(batches, docs, risks, ai, pairs), f"{tmp_path}/json", files=9)
    nested = io.export_documents(batches, docs, risks, ai, pairs)
    want = {r["batch"]: json.loads(r["j"]) for r in nested.select("batch", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()}
    got, files = {}, {}
    for folder in (tmp_path / "json").iterdir():
        if folder.is_dir():
            parts = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
            document = json.loads("".join(p.read_text() for p in parts))
            got[document["batch"]], files[document["batch"]] = document, len(parts)
    assert got == want and files["b/1"] > 3 and got["none"] == {"batch": "none", "name": "n", "total": 0.0, "submissions": [], "similarity_pairs": []}


def test_tiles(spark):
    n = 23
    docs = spark.createDataFrame([("x", i, f"s{(i * 7) % n:02d}") for i in range(n)] + [("y", 99, "a")], "batch string, doc long, student_id string")
    some = {(a, b): (a + b) / 50 for a in range(n) for b in range(a + 1, n) if (a * b) % 11 == 5}
    pairs = spark.createDataFrame([("x", a, b, v) for (a, b), v in some.items()], "batch string, a long, b long, fused double")
    tiles = results.heatmap_tiles(docs, pairs, ["student_id"], 4)
    assert tiles.count() <= len(some) and tiles.agg(F.sum(F.size("cells"))).first()[0] == len(some)
    sizes = spark.createDataFrame([("x", n), ("y", 1)], "batch string, n int")
    wanted = sizes.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int"))))
    wanted = wanted.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int"))))
    got = {(r["batch"], r["i"], r["j"]): r["score"] for r in results.tile_cells(tiles, wanted, 4).collect()}
    order = {i: (i * 7) % n for i in range(n)}
    cells = {(order[a], order[b]): v for (a, b), v in some.items()}
    assert got == {("x", i, j): 1.0 if i == j else cells.get((i, j), cells.get((j, i), 0.0)) for i in range(n) for j in range(n)} | {("y", 0, 0): 1.0}


def test_curves(spark):
    """Pooling against its definition, the least over beginnings of the greatest mean over ends."""
    rng = random.Random(7)
    for _ in range(200):
        bins = [(b, rng.randrange(1, 9), 0) for b in range(rng.randrange(1, 12))]
        bins = [(b, n, rng.randrange(n + 1)) for b, n, _ in bins]
        mean = lambda j, k: sum(x[2] for x in bins[j : k + 1]) / sum(x[1] for x in bins[j : k + 1])  # noqa: B023, E731
        want = [min(max(mean(j, k) for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
        assert [p for _, p in calibration.pooled(bins)] == pytest.approx(want)
    rows = [(i, 3.0 + i, 1.0 if i % 5 else None, int(i < 40 or i % 4 == 0)) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc long, perplexity double, burstiness double, y int")
    curve = calibration.Curve.fit(frame, "perplexity", "y")
    assert all(p >= q for (_, p), (_, q) in zip(curve.points, curve.points[1:])) and curve.points[0][1] == 1.0
    got = {r["doc"]: r for r in calibration.calibrated(frame.drop("y").union(spark.createDataFrame([(200, 1e-9, 5.0), (201, 1e12, None), (202, None, None)], "doc long, perplexity double, burstiness double")), frame.select("doc", "y")).collect()}
    assert got[200]["perplexity"] == 20.0 == got[0]["perplexity"] and got[201]["perplexity"] == got[99]["perplexity"] > 100 and got[202]["perplexity"] is None
    assert got[0]["burstiness"] is None and len({r["burstiness"] for r in got.values() if r["burstiness"] is not None}) == 1  # one bin: it says nothing
    none = calibration.Curve.fit(frame.limit(0), "perplexity", "y")
    assert frame.select(none.perplexity(F.col("perplexity")).alias("p")).first()["p"] is None


def test_registry(spark, tmp_path):
    """Training activates, a rollback does so again, an unknown version is refused; the active model is the one that was saved."""
    rows = lambda sign: spark.createDataFrame([(i, i % 2, 20.0 + sign * 40 * (i % 2) + 50, 5.0 + i % 3, 0.5) for i in range(40)], "doc long, y int, perplexity double, burstiness double, stylometric double")
    registry = training.ModelRegistry(spark, f"{tmp_path}/models")
    up, down = training.fit(rows(1)), training.fit(rows(-1))
    registry.save("v1", up, {"auc": 0.7})
    registry.save("v2", down, {"auc": 0.8})
    state = lambda: {r["version"]: r["is_active"] for r in registry.runs().collect()}
    assert state() == {"v1": False, "v2": True}
    registry.activate("v1")
    assert state() == {"v1": True, "v2": False}
    with pytest.raises(ValueError, match="no such version"):
        registry.activate("v3")
    p = lambda m: [r["probability"][1] for r in m.transform(rows(1)).orderBy("doc").collect()]
    assert p(registry.active()) == pytest.approx(p(up)) and p(up) != pytest.approx(p(down))
    assert registry.entries().where("event = 'trained' and version = 'v2'").first()["metrics"] == {"auc": 0.8}
