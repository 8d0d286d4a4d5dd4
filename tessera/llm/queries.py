"""The opN queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import (
    alignment_queries,
    bpe_queries,
    divergence_queries,
    jaccard_queries,
    packing_queries,
    pii_queries,
    pq_queries,
    quality_queries,
    token_counts_queries,
    toxicity_queries,
    urls_queries,
    vafile_queries,
    warc_queries,
)

MODULES = [
    urls_queries,
    pq_queries,
    token_counts_queries,
    toxicity_queries,
    vafile_queries,
    jaccard_queries,
    bpe_queries,
    quality_queries,
    pii_queries,
    packing_queries,
    warc_queries,
    divergence_queries,
    alignment_queries,
]


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
