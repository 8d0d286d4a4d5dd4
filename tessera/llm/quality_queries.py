"""op8: a quality score for every document."""

from pyspark.sql import functions as F

from tessera.llm.quality import score_documents, train

NAME = "op8_subword_quality"
THRESHOLD = 0.7


def query(spark, sf_dir):
    """Scores of all documents by a model of the labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, train(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
