"""Classifiers, personal data and URL verdicts."""

import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii, quality, toxicity, urls


def labelled(spark, make_docs, n=600):
    """Toxic texts hold an insult and often 'she'; neutral ones often 'he'."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(["tree", "house", "river", "stone", "paper", "cloud"]) for _ in range(40)]
        if bad:
            w[3] = rng.choice(["zorkhead", "zorkface", "blurg"])
        w[7] = "she" if (rng.random() < (0.9 if bad else 0.1)) else "he"
        if i % 3 == 0:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(i % 3 != 0), int(bad)))
    return make_docs([*rows, (9001, None, "s"), (9002, "", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all((got[i]["score"] >= 0.3) == (y[i] == 1) for i in y if got[i]["held_out"])
    assert got[9001]["score"] == got[9002]["score"] < 0.3
    new, none = model.score(["zorkwhatever river", "plain river"])
    assert new > 2 * none  # a new word that begins like an insult
    free = toxicity.train(docs, labels, counterfactual=0.0)
    gap = lambda m: abs(m.score(["she tree"])[0] - m.score(["he tree"])[0])
    assert gap(model) < 0.5 * gap(free) + 1e-6
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.train(docs.limit(0), labels).score(["x"])[0] < 0.3


def test_quality(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    model = quality.train(docs, labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    assert all((got[i]["score"] >= 0.7) == (y[i] == 1) for i in y if got[i]["held_out"])
    assert 0 <= got[9001]["score"] <= 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                yield k, m.start(), m.end()


def test_base_spans():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice(rng.choice(["0123456789.@+- ()", "ab@.c-_", "+1 (9)8-7."])) for _ in range(50))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == list(plain(t))
    assert pii.base_spans("9" * 200_000) == []


def test_consistency_and_redaction(spark, make_docs):
    text = "call +1 (301) 555-0346 now. Later (301) 555-0346 rang. Year 2024, page 12."
    docs = make_docs([text, None, "", "no data", "mail a.b@x.org " * 30, *[f"ring +1 (3{i:02d}) 555-0{i:03d} or not in 20{i:02d}" for i in range(60)]])
    model = pii.train(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    spans = [(s["kind"], text[s["start"] : s["end"]]) for s in got[0]["spans"]]
    assert ("phone", "+1 (301) 555-0346") in spans and any("555-0346" in t for k, t in spans[1:] if k == "phone")
    assert not any("2024" in t or t == "12" for _, t in spans)
    assert got[1]["spans"] == got[2]["spans"] == got[3]["spans"] == [] and len(got[4]["base"]) == 30
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert "555-0346" not in clean[0] and clean[1] is None and clean[3] == "no data"


def test_urls(spark):
    link = "<html><link rel='canonical' href='{}'></html>"
    rows = [
        (1, "http://a.example.org/es/x", None), (2, "HTTP://A.EXAMPLE.ORG/en/1?q=1", None), (3, "http://b.net/x", link.format("http://a.example.org/es/x")), (4, "https://b.net/x/#t", None),
        (5, "http://c.net", "<meta http-equiv=refresh content='0; url=http://b.net/x'>"), (6, None, None), (7, "nothing", None), (8, "http://d.net/y", link.format("http://q.com/fr/ok")),
        (9, "http://d.net/y", link.format("http://q.com/de/no")), (10, "http://e.net/z", "<p>"), (10, "http://e.net/z", "<p>"), (11, "http://notexample.org/es/", None),
        (12, "http://f.net/item?id=1", link.format("http://q.com/de/no2")), (13, "http://f.net/item?id=2", None), (14, "http://f.net/item?id=1#x", None), (15, "http://q.com/de", None),
        (16, "http://g.net/", f"<LINK data-x='{'y' * 2500}' title=z REL=\"next canonical\" href=\"//q.com/de/x?a=1&amp;b=2\">"),
        (17, "http://h.net/", "<link rel=canonical href=http://h.net/own><link rel='canonical' href='http://i.net/ok'><link rel=canonical href=http://q.com/de/late>"),
        (18, "http://j.net/a/b?q=1", "<link rel=canonical href=c.html>"), (19, "http://j.net/a/c.html", "<meta content='3;URL=../../de/../k' http-equiv='Refresh'>"), (20, "http://j.net/k", link.format("http://x.example.org/en/12")),
        (21, "http://k.net/", "<link rel=canonicalish href=http://q.com/de/z><link rel=next href=http://q.com/de/z><a rel=canonical href=http://q.com/de/z>"), (22, "http://l.net/", link.format("mailto:x@q.com") + "<link " * 3), (23, "https://q.com/de/", None),
    ]
    from tessera.llm.urls_queries import RULES

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"verdict": F.lit("x"), "address": F.lit(1), "node": F.lit(2), "own": F.lit(3)})
    got = {r["page_id"]: r for r in urls.judge(pages, RULES).collect()}
    blocked = {1, 2, 3, 4, 5, 12, 14, 15, 16, 17, 18, 19, 20, 23}  # 8 and 9: one address, with an allowed and a blocked alias
    assert {i for i, r in got.items() if r["verdict"] == "block"} == blocked and set(got) == set(range(1, 24))
    assert got[1]["rule"] == "example.org/es/" and got[2]["host"] == "a.example.org" and got[2]["path"] == "/en/1" and got[11]["rule"] == "org/"
    assert (got[6]["host"], got[6]["path"], got[6]["rule"]) == ("", "", None)
    assert urls.judge(pages.limit(0), RULES).count() == 0
    table = spark.createDataFrame([*RULES, (None, "block"), ("unused.net/", "block")], "rule string, verdict string")
    joined = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, table).collect()}
    assert joined == {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    crawl = spark.createDataFrame([("http://e.net/z", "http://q.com/de/moved")], "a string, b string")
    more = {r["page_id"]: r["verdict"] for r in urls.judge(pages.drop("html"), RULES, redirects=crawl, spellings=False).collect()}
    assert {i for i, v in more.items() if v == "block"} == {1, 2, 10, 23}


def test_relative_targets(spark):
    from urllib.parse import urljoin

    bases = ["http://a.b/c/d?q=1#f", "https://A.b", "http://a.b/", "http://a.b/c/d/e/"]
    some = ["x", "./x", "../x", "../../../x", "/x/../y/./z", "?q=2", "//h.i/x", "http://z/x", "x/..", "x/y?z=../w", "..", "."]
    rows = spark.createDataFrame([(b, t) for b in bases for t in some], "u string, t string")
    for r in rows.withColumn("to", urls.resolved(F.col("u"), F.col("t"))).collect():
        assert r["to"] == urljoin(r["u"], r["t"]), r


def test_a_million_rules(spark):
    """A table of rules is joined; each of some urls has the longest rule that fits, as trying all of them would say."""
    rules = spark.range(1_000_000).select(F.concat(F.lit("h"), (F.col("id") % 50_000).cast("string"), F.lit(".net/"), F.when(F.col("id") >= 50_000, (F.col("id") % 1009).cast("string")).otherwise("")).alias("rule"), F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("verdict"))
    hosts = [f"{sub}h{h}.net" for sub in ("", "a.", "b.c.", "x") for h in (0, 7, 49_999, 50_000)]
    places = spark.createDataFrame([(h, p) for h in hosts for p in ("/", "/7", "/57", "/100", "/1008/x", "", "/x7")] + [("", ""), ("h7.net", "/57")], "host string, path string")
    some = rules.where(F.col("rule").rlike("^h(0|7|49999|50000)[.]")).collect()
    fits = lambda h, p, r: (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0])) and p.startswith("/" + r.partition("/")[2])
    want = {}
    for h, p in {tuple(r) for r in places.collect()}:
        found = [(len(r["rule"]), r["verdict"] == "allow", r["rule"]) for r in some if fits(h, p, r["rule"])]
        if found:
            want[h, p] = max(found)
    got = {(r["host"], r["path"]): tuple(r["own"]) for r in urls.fitting(places, rules).collect()}
    assert got == want and len(want) > 40
