"""Packing with more than a thousand sources."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm.test_tokens import check_packed


def test_each_source_is_a_queue(make_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rows = [(i, "one small page of its own", f"small{i}") for i in range(1500)] + [(5000 + i, "many words of the large source " * 30, "large") for i in range(100)]
    ids = {i: np.array(tk.encode(t, add_special_tokens=False).ids + [2]) for i, t, _ in rows}
    got = packing.pack(make_docs(rows), path, window=256).collect()
    check_packed(got, ids, 256)
    assert {(r["doc_id"], r["queue"]) for r in got} == {(i, "s" + s) for i, _, s in rows}
    total, large = sum(map(len, ids.values())), sum(len(ids[i]) for i, _, s in rows if s == "large")
    own = np.zeros(total // 256)
    for r in got:
        if r["sequence_id"] < len(own) and r["queue"] == "slarge":
            own[r["sequence_id"]] += r["length"]
    # the large source's share of every window; small sources take turns
    assert abs(own[:-1] - 256 * large / total).max() <= 4
    for w in range(len(own) - 1):
        assert len({r["queue"] for r in got if r["sequence_id"] == w}) > 20
