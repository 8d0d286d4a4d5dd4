"""op13: links between the tokens of two tokenizers in every document, with corpus-wide counts of the linked id pairs."""

import public_tokenizers

from tessera.llm.alignment import align_documents

NAME = "op13_tokenizer_alignment"
SIDE_A = public_tokenizers.path("byte_bpe_50k.json")
SIDE_B = public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir):
    """Every document's alignment; all texts are read once."""
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), SIDE_A, SIDE_B)
