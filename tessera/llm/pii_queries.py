"""op9: personal data in every document."""

from pyspark.sql import functions as F

from tessera.llm.pii import find, train

NAME = "op9_skip_chain_pii"


def query(spark, sf_dir):
    """Base and added spans of all documents, by a field taught on a bounded sample of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in ("email", "ip", "card", "phone")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
