"""The histogram against plain counts of the library's encoding."""

import public_tokenizers
import tiktoken

from tessera.llm import bpe, token_counts


def test_limits(spark, make_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.encoder(path, public_tokenizers.PATTERN).table.ranks
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "one", "one two", *["word " * n for n in (3, 3, 5, 900, 1500, 5000)]]
    sizes = [len(ref.encode_ordinary(t or "")) for t in texts]
    table = token_counts.limits(token_counts.length_histogram(make_docs(texts), path, public_tokenizers.PATTERN))
    got = {r["n_tokens"]: r for r in table.collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert (r["n_docs"], r["docs_at_most"], r["docs_longer"]) == (sizes.count(n), sum(x <= n for x in sizes), sum(x > n for x in sizes))
        assert (r["tokens_at_most"], r["truncated_total"]) == (sum(x for x in sizes if x <= n), sum(min(x, n) for x in sizes))
    for q in token_counts.LEVELS:
        (n,) = (r["n_tokens"] for r in got.values() if str(q) in r["quantiles"].split(","))
        assert n == min(x for x in sizes if sum(y <= x for y in sizes) >= q * len(sizes)) == token_counts.quantile(table, q).first()["n_tokens"]
    assert token_counts.quantile(table, 0.5).first()["n_tokens"] == sorted(sizes)[len(sizes) // 2 - 1]
    assert token_counts.truncated_total(table, 1000).first()["total"] == sum(min(x, 1000) for x in sizes)
    assert token_counts.limits(token_counts.length_histogram(make_docs([]), path, public_tokenizers.PATTERN)).count() == 0
