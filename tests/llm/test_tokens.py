"""Encoders against their libraries, packing against its own rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, pieces

ODD = ["", " ", "\n\n x", "don't we'll 'tis ''s", "aaaaaaaaaa aaaa", "a\tb \x85c", "\U0001f600\U0001f600", "x" * 5000, "İstanbul ΑΣ", "tab\t\there  two", "<|endoftext|> end"]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab c\n'sé日 1.,!") for _ in range(120)) for _ in range(150)]


def test_byte_bpe(spark, make_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.encoder(path, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.table.ranks, special_tokens={})
    docs = make_docs([*texts(), None])
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate([*texts(), ""]):
        assert got[i]["token_ids"] == ref.encode_ordinary(t) and bytes(got[i]["decoded"]) == t.encode()
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()}
    assert back[5] == ODD[5]
    assert bpe.digest_documents(make_docs([]), path, public_tokenizers.PATTERN).count() == 0


def test_any_pattern_and_replay_order():
    table = bpe.MergeTable({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"bc": 258, b"aa": 259})
    e = bpe.Encoder(table, r"\S+|\s+")
    for t in ("abab abc", "aaaaa", "ababab"):
        assert e.encode([t])[0] == [x for w in e.find(t) for x in ([table.ranks[w.encode()]] if w.encode() in table.ranks else table.one_by_one(w.encode()))]


def test_piece_table():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in rng.integers(1, 100, 4000)]
    data, size = b"".join(words), np.array([len(w) for w in words])
    end = np.cumsum(size)

    def learn(some):
        return np.frombuffer(b"".join(data[a:b] for _, a, b in some), np.uint8).astype(np.int32), np.array([b - a for _, a, b in some], np.int32)

    table = pieces.IdTable(keep=1000)
    for lo in range(0, 4000, 500):  # forgets, and learns again
        (row,) = pieces.rows_of(table, [(data, end[lo : lo + 500] - size[lo : lo + 500], end[lo : lo + 500])], learn)
        assert table.lay(row)[0].astype(np.uint8).tobytes() == b"".join(words[lo : lo + 500])
    assert table.n <= 1000
    hashes = pieces.range_hashes
    try:
        pieces.range_hashes = lambda *a: (hashes(*a)[0] & np.uint64(3), hashes(*a)[1])  # nearly all first hashes clash
        table = pieces.IdTable()
        (row,) = pieces.rows_of(table, [(data, end[:300] - size[:300], end[:300])], learn)
        assert table.lay(row)[0].astype(np.uint8).tobytes() == b"".join(words[:300])
    finally:
        pieces.range_hashes = hashes


def check_pieces(rows, ids):
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(own)


def check_packed(rows, ids, window):
    check_pieces(rows, ids)
    sizes = {}
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes[s] = at
    assert all(n == window or n & (n - 1) == 0 for n in sizes.values()) and sorted(sizes) == list(range(len(sizes)))


def test_word_encoder_is_the_library_by_default():
    path = public_tokenizers.path("word_bpe_49k.json")
    tk, own = Tokenizer.from_file(path), packing.WordEncoder(path, 2, keep=300)
    rng = random.Random(8)
    pool = ["a", "B", "'s", "'RE", "'", " ", "\n", "\x0b", "\x85", "\xa0", "é", "É", "İ", "ı", "×", "÷", "Σ", "日本", "1", "23", "½", "!!", "_", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "e\u0301", "ﬁ", "\x00", "😀", "l'homme", "word"]
    for _ in range(300):
        some = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(10)]
        assert [x.tolist() for x in own(some)] == [tk.encode(t, add_special_tokens=False).ids + [2] for t in some]


def test_mixture_beyond_2_to_45_tokens():
    totals = [1 << 47, (1 << 46) + 12345, 999, (1 << 44) + 7]
    m = packing.Mixture(totals)
    weights, starts, order = m.weights.tolist(), m.start.tolist(), m.totals.tolist()
    for slot in (0, 1, 1 << 20, (1 << 45) + 11, 1 << 47, m.end):
        own = [min(t, (slot * w + s) >> packing.BITS) for t, w, s in zip(order, weights, starts)]
        assert m.own(np.full(4, slot), np.arange(4)).tolist() == own and m.groups(np.array([slot]))[0, -1] == sum(own)
    q, k = np.array([3, 3, 2]), np.array([0, (1 << 46) + 5, 1 << 44])
    place = m.position(q, k)
    own, _ = m.at(place, np.arange(3), q)
    assert own.tolist() == k.tolist() and (m.at(place + 1, np.arange(3), q)[0] == k + 1).all()


def test_packing(spark, make_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rows = [(i, t, ["a", "b", "c"][i % 3 if i % 5 else 0]) for i, t in enumerate(texts())] + [(900, None, None)]
    ids = {i: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows}
    for weights in (None, {"a": 1.0, "b": 3.0}):
        got = packing.pack(make_docs(rows), path, window=256, weights=weights).collect()
        check_packed(got, ids, 256)
    total = sum(map(len, ids.values()))
    whole = [r for r in packing.pack(make_docs(rows), path, window=256).collect() if r["sequence_id"] < total // 256]
    for q in {r["queue"] for r in whole}:
        share = sum(len(ids[i]) for i, _, s in rows if ("s" + s if s else "null") == q) / total
        for s in {r["sequence_id"] for r in whole}:
            assert abs(sum(r["length"] for r in whole if r["sequence_id"] == s and r["queue"] == q) - 256 * share) <= 3
    assert packing.pack(make_docs([]), path).count() == 0
