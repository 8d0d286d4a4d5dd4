"""Repeated rows, null ids and extra columns with clashing names, for operators whose other tests have none."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import bpe, packing, token_counts, vafile

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
CLASH = ["1 as n_tokens", "'x' as n_docs", "2 as bin", "3 as pid", "4 as idx", "5 as queue", "6 as start", "7 as length", "8 as sequence_id", "9 as ids", "10 as uid", "11 as score", "12 as rank", "13 as cell"]


def repeated(make_docs):
    docs = make_docs([(1, "one two", "s"), (1, "one two", "s"), (1, "three", "t"), (2, None, None), (3, "", "s"), (4, "word " * 50, "t"), (4, "word " * 50, "t")])
    return docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))


def test_lengths(make_docs):
    docs = repeated(make_docs)
    plain = token_counts.length_histogram(docs, RANKS, public_tokenizers.PATTERN)
    got = {r["n_tokens"]: r["n_docs"] for r in plain.collect()}
    assert sum(got.values()) == 8 and got[0] == 2 and got[2] == 3
    clash = token_counts.limits(token_counts.length_histogram(docs.selectExpr("*", *CLASH), RANKS, public_tokenizers.PATTERN))
    assert {r["n_tokens"]: r["n_docs"] for r in clash.collect()} == got


def test_encoding(make_docs):
    docs = repeated(make_docs)
    rows = lambda d: Counter(map(tuple, bpe.digest_documents(d, RANKS, public_tokenizers.PATTERN).collect()))
    got = rows(docs)
    assert sum(got.values()) == 8 and {r[0] for r in got} == {1, 2, 3, 4, None} and max(got.values()) == 2
    assert rows(docs.selectExpr("*", *CLASH, "14 as ids_sha256")) == got


def test_packing(make_docs):
    """Every row is packed, repeated ones as often as they occur; what else the table has is nothing to it."""
    docs = repeated(make_docs)
    for d in (docs, docs.selectExpr("*", *CLASH)):
        rows = packing.pack(d, WORDS).collect()
        held = Counter()
        for r in rows:
            held[r["doc_id"]] += r["length"]
        assert held == {1: 3 + 3 + 2, 2: 1, 3: 1, 4: 51 * 2, None: 3}
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in by.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length


def test_search(spark):
    rows = spark.createDataFrame([(i % 20, [float(i % 20), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    ask = lambda r: sorted(map(tuple, vafile.top_k(vafile.quantised(r), vafile.quantised(r).where("vec_id = 3"), 3).collect()))
    got = ask(rows)
    assert got and ask(rows.selectExpr("*", *CLASH)) == got and {r[0] for r in got} == {3}
