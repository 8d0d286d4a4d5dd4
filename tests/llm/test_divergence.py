"""The audit against its definition in plain whole numbers."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, most=10):
    """rows: (text, lang, source)."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        words = TERM.findall((text or "").translate(UPPER))
        count[key].update(words)
        df[key[0]].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: count[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c: {t: 1 + 1_000_000_000 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        far = lambda x, y: (x - y) ** 2 // (x + y)
        ps, q = {s: p(c) for s, c in own.items()}, p(whole)
        order = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
        for s in own:
            pairs = [(o, sum(far(ps[s][t], ps[o][t]) for t in kept)) for o in own if o != s]
            out += [(lang, s, "pair", o, v, i + 1) for i, (o, v) in enumerate(order(pairs))]
            terms = [(t, far(ps[s][t], q[t])) for t in kept if own[s][t] and ps[s][t] > q[t]]
            out += [(lang, s, "term", t, v, i + 1) for i, (t, v) in enumerate(order(terms)[:most])]
    return sorted(out)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["Tree", "river", "stone", "été", "ÉTÉ", "naïve", "日本", "🙂ok", "don't", "a1b", "x_y", "Zoo", "\x7fdel", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "xx"])
        source = None if rng.random() < 0.05 else "s" + str(min(11, int(rng.expovariate(0.4))))
        text = rng.choice([None, "", "12 34"]) if rng.random() < 0.05 or lang == "xx" else " ".join(rng.choice(words[:: 1 + int(source[1:] if source else 0) % 5]) for _ in range(rng.randrange(60)))
        rows.append((text, lang, source))
    return rows + [("again Tree", "en", "s1")] * 12 + [("river " * 5, "de", "empty?")] + [("one", "solo", "s")]


def frame(spark, rows):
    return spark.createDataFrame([(i % 50, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_audit(spark):
    rows = corpus()
    want = plain(rows)
    docs = frame(spark, rows).repartition(6)
    for blocks in ({}, {"group_block": 2, "term_block": 16}):
        got = sorted(map(tuple, divergence.audit(docs, **blocks).collect()))
        assert got == want
    assert {w[2] for w in want} == {"pair", "term"} and any(w[4] == 0 for w in want)


def test_counts_are_flushed_and_added(spark):
    rows = corpus(60)
    small, large = (sorted(map(tuple, divergence.term_counts(frame(spark, rows), most=m).collect())) for m in (5, 10**6))
    assert small == large and len({x[:3] for x in small}) == len(small)
    assert [t for part in divergence.terms(b"Ab c1d EF" * 100, piece=7) for t in part] == re.findall(rb"[a-z]+", b"Ab c1d EF".lower() * 100)


def test_whole_numbers(spark):
    big = [(0, 3, 2), (10**17, 10**18, 5), (10**6 - 2, 10**6 - 2, 1), (5 * 10**18, 9 * 10**18, 10**6)]
    got = spark.createDataFrame(big, "c long, n long, v long").select(divergence.smoothed(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 1_000_000_000 * (c + 2) // (n + 2 * v) for c, n, v in big]


def test_empty_and_clashing_columns(spark):
    assert divergence.audit(frame(spark, []).where("false")).count() == 0
    rows = corpus(80)
    docs = frame(spark, rows).selectExpr("*", "1 as term", "2 as n", "3 as p", "4 as item", "5 as rank", "6 as part")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain(rows)
