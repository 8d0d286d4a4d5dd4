"""op10: all documents packed into sequences of 4096 tokens at the corpus's own mixture."""

import public_tokenizers

from tessera.llm.packing import pack

NAME = "op10_mixture_packing"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    """The pieces of all documents in windows of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)
