"""Token alignment against the libraries' own encodings, linked and counted plainly."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(ids, ends) of both sides, or None where the bytes differ."""
    t, sp = libraries
    if not text:
        return None
    byte = alignment.byte_of()
    enc = t.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in enc.ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else None


def plain(libraries, texts):
    """The contract's columns by its definitions, one text after another."""
    found, linked = [], Counter()
    for text in texts:
        both = tokens(libraries, text)
        if both is None:
            found.append(None)
            continue
        sides = []
        for side in both:
            at, rows = 0, []
            for i, x in side:
                rows.append((i, at, at + len(x)))
                at += len(x)
            sides.append(rows)
        links, j = [], 0
        for i, lo, hi in sides[0]:
            while sides[1][j][2] <= lo:
                j += 1
            k = j
            while k < len(sides[1]) and sides[1][k][1] < hi:
                links.append((i, sides[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
        lo, groups = 0, []
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, x, y in side if lo <= x and y <= e) for side in sides) if len(text) < 3000 else None)
            lo = e
        found.append((len(sides[0]), len(sides[1]), groups, links))
        linked.update(set(links))
    top = {}
    for (i, _), n in linked.items():
        top[i] = max(n, top.get(i, 0))
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, "", 0, 0))
            continue
        na, nb, groups, links = f
        sha = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((na, nb, len(groups), len(links), sha, sum(linked[x] == top[x[0]] for x in links), sum(linked[x] for x in links)))
    return out


def odd_texts(n=300, seed=4):
    rng = random.Random(seed)
    parts = ["the", "The", " ", "  ", "   ", "\n", "\t", "naïve", "été", "日本語", "🙂", "don't", "we'll", "1234", "x=1;", "<s>", "</s>", "<unk>", "<|endoftext|>", "▁", "​", " ", "\x00", "\x1f", "ß", "Ω≈", "....", "a" * 40, "﻿", "👩‍👩‍👧", "'s", "0x0A", "<0x0A>", "é"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_each_text_encodes_as_the_libraries_do(libraries):
    al = alignment.Aligner(A, B)
    texts = [t for t in odd_texts(2000, 5) if t]
    a, b = al.a.ids([" " + t for t in texts]), al.b.ids([" " + t for t in texts])
    t, sp = libraries
    for text, x, y in zip(texts, a, b):
        assert t.encode(" " + text, add_special_tokens=False).ids == x.tolist()
        if tokens(libraries, text) is None:
            assert (y == al.b.bad).any() and "▁" in text
        else:
            assert sp.encode(text) == y.tolist()


def test_alignment(spark, make_docs, libraries):
    rng = random.Random(6)
    texts = [None, "", " ", "one", "a ▁ b", *odd_texts(), *["the cat sat, the cat ran."] * 5, "word " * 20_000 + "end"]
    rng.shuffle(texts)
    docs = make_docs(texts).unionByName(make_docs([(7, "one more", "s"), (7, "one more", "s")])).repartition(5)
    ids = docs.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(ids, plain(libraries, [r["text"] for r in ids])) if x[4] is not None)
    # small runs, so that the tree has several levels
    found = alignment.align_documents(docs, A, B, parts=3, fan=2, chunk=600)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = Counter(tuple(r[c] for c in ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]) for r in found.collect())
    assert found.columns == names and not want - got and sum(got.values()) == len(ids)
    whole = Counter(tuple(r[c] for c in names) for r in alignment.align_documents(docs, A, B).collect())
    assert whole == got
    long = [x for x in plain(libraries, [r["text"] for r in ids]) if x[4] is None]
    rest = got - want
    assert [x[1:5] for x in rest] == [x[:4] for x in long] and [x[6:] for x in rest] == [x[5:] for x in long]


def test_long_texts_in_segments(libraries):
    al = alignment.Aligner(A, B)
    text = "Some words, and  more\n of them. " * 50
    cut = alignment.segments(text, 100)
    assert len(cut) > 10 and "".join(cut) == " " + text
    rows, pair, _ = al.align(cut)
    (one,), whole, _ = al.align([" " + text])
    assert [sum(r[k] for r in rows) for k in range(4)] == list(one[:4]) and ";".join(r[4] for r in rows) == one[4] and pair.tolist() == whole.tolist()
    assert len(alignment.segments("x" * 1000, 100)) == 1


def test_every_token_encodes_to_itself(libraries):
    """So that a piece that is a token may be told without its merges."""
    t, _ = libraries
    table = alignment.ListedMerges(A)
    odd = random.Random(2).sample(sorted(table.bytes_of), 3000)
    assert all(table.one_by_one(table.bytes_of[i]) == [i] for i in odd)


def test_empty_table_and_extra_columns(spark, make_docs):
    assert alignment.align_documents(make_docs([]), A, B).count() == 0
    docs = make_docs(["a b c"]).selectExpr("*", "1 as chunk", "2 as i", "3 as part", "4 as n_a")
    assert alignment.align_documents(docs, A, B).first()["n_a"] == 3
