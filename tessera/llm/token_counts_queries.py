"""op3: documents, tokens and truncated totals for every context limit."""

import public_tokenizers

from tessera.llm.token_counts import length_histogram, limits

NAME = "op3_length_histogram"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark, sf_dir):
    """Totals for every length that occurs, over all documents."""
    return limits(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY, public_tokenizers.PATTERN))
