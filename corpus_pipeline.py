"""Corpus preparation: the stages in order, each over all that its predecessor kept.

Each stage is written as Parquet in the shared folder and read again as the next one's documents, so a
lost executor costs at most the running stage's unfinished tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, pii, quality, toxicity
from tessera.llm.jaccard import JaccardJoin
from tessera.llm.scratch import Scratch

TOXIC_FROM, GOOD_FROM = 0.3, 0.7
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of some documents; the classifiers leave out those that are held out."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score reaches TOXIC_FROM. Null and empty texts score the prior and stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _labels(spark, sf_dir)), TOXIC_FROM)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches GOOD_FROM. Null and empty texts score the prior."""
    return quality.keep_good(docs, quality.train(docs, _labels(spark, sf_dir)), GOOD_FROM)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate component.

    Rows that share a doc_id are one document to the join: of those with words the one with the smallest text stays.
    Texts without words and rows without a doc_id all stay.
    """
    placed = JaccardJoin().components(docs).where("n_shingles > 0 and doc_id is not null")
    gone, again = (_unused(docs, c) for c in ("gone", "again"))
    marks = placed.groupBy("doc_id").agg((F.min("component_id") != F.col("doc_id")).alias(gone), (F.count("*") > 1).alias(again)).where(F.col(gone) | F.col(again))
    marked = docs.join(marks, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in (gone, again)})
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    sole = marked.where(~worded | ~(F.col(gone) | F.col(again))).select(*docs.columns)
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("r")
    several = marked.where(worded & F.col(again) & ~F.col(gone)).groupBy("doc_id").agg(F.min_by(whole, "text").alias("r")).select("r.*")
    return sole.unionByName(several)


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    return "_" * (1 + max((len(c) for c in docs.columns), default=0)) + name


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its personal data replaced by the kind in angle brackets and n_chars counted again."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens at the corpus's own mixture of sources."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None  # classifiers and a random field have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; a stage's table goes once the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
            scratch.keep(docs)
    return docs
