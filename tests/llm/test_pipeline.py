"""Every stage of the pipeline on odd rows, and the whole of it on a small folder."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_pieces

CLASH = {"gone": 1, "again": 2, "score": 3, "component_id": 4, "kind": 5, "queue": 6, "h": 7, "y": 8}


def corpus():
    """Good and poor, clean and toxic texts, copies, near copies, personal data, and odd rows."""
    rng = random.Random(4)
    words = ["tree", "house", "river", "stone", "paper", "cloud", "garden", "winter", "letter", "market"]
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(30)]
        toxic, poor = i % 5 == 0, i % 4 == 0
        if toxic:
            w[3:5] = ["zorkhead", "blurg"]
        if poor:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(not poor), int(toxic)))
    plain = next(t for i, t, _ in rows if i % 5 and i % 4)
    rows += [(1000 + k, plain, "s0") for k in range(4)] + [(1010, plain + " garden", "s1"), (1011, plain + " mail ann.lee@mail.org or 10.1.2.3", "s1")]
    rows += [(2000, None, None), (2001, "", "s0"), (None, plain, "s0"), (1010, plain + " again", "s1"), (2002, "one long line " * 4000, "s2"), (2003, " \t", None)]
    return rows, labels


@pytest.fixture
def folder(spark, make_docs, tmp_path):
    rows, labels = corpus()
    docs = make_docs(rows).withColumns({c: F.lit(n) for c, n in CLASH.items()})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_and_whole_run(spark, folder):
    rows, labels = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]

    clean = stages["toxicity"](spark, docs, folder)
    got = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns and got >= {2000, 2001, None, 1000} and not any(i in got for i, _, t in labels if t)
    good = stages["quality"](spark, docs, folder)
    got = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns and got >= {i for i, q, _ in labels if q} and not any(i in got for i, q, _ in labels if not q)

    sole = stages["near_duplicates"](spark, docs, folder)
    got = [(r["doc_id"], r["text"]) for r in sole.collect()]
    with_id = [r for r in rows if r[0] is not None]
    part = {i: c for i, _, c in brute(with_id)}
    want = [(i, t) for i, t, _ in rows if i is None or not (t or "").strip() or part[i] == i]
    assert sole.columns == docs.columns and sorted(got, key=str) == sorted(want, key=str)

    bare = stages["personal_data"](spark, docs, folder)
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in bare.collect()}
    assert bare.columns == docs.columns and bare.count() == len(rows)
    assert any(i == 1011 and t.endswith("mail <email> or <ip>") and n == len(t) for i, t, n in got) and not any(re.search("ann.lee|10.1.2.3", t or "") for _, t, _ in got)

    tk = Tokenizer.from_file(P.VOCABULARY)
    own = [np.array(tk.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows]
    pieces = stages["packing"](spark, docs, folder).collect()
    assert sum(r["length"] for r in pieces) == sum(map(len, own))
    ids = {i: x for (i, _, _), x in zip(rows, own) if i not in (None, 1010)}
    check_pieces(pieces, ids)

    out = P.run(spark, folder).collect()
    left = {r["doc_id"] for r in out}
    assert 1000 not in left and not any(i in left for i, q, t in labels if t or not q)  # copies of an earlier document, toxic and poor ones
    whole = {i: sum(r["length"] for r in out if r["doc_id"] == i) for i in left}
    assert all(n == next(r["doc_tokens"] for r in out if r["doc_id"] == i) for i, n in whole.items())


def test_empty_documents(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0
