"""op7: byte-level BPE ids of every document, and their decoding."""

import public_tokenizers

from tessera.llm.bpe import digest_documents

NAME = "op7_byte_bpe"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark, sf_dir):
    """Ids and decoded bytes of all documents, as digests."""
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY, public_tokenizers.PATTERN)
