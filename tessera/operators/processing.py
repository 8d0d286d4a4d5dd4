"""Batches from raw texts to pairs, signals, risks and marks, stage by stage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import params as P
from tessera.functions import scores
from tessera.functions import text as T
from tessera.operators import authorship, calibration, code, marking, products, similarity
from tessera.scratch import Scratch
from tessera.sources import io


def parse(submissions: DataFrame) -> DataFrame:
    """(batch, doc, student_id, student_name, text, blocks, has_code, status) of raw (batch, doc, text).

    The text is sanitised, then parted into prose, which is the text from here on, and code blocks. Blank texts have status
    parse_error and no text.
    """
    rows = T.sanitized(submissions.select("batch", "doc", "text"), "text").withColumn("status", T.parse_status(F.col("text")))
    rows = rows.withColumns({"student_id": T.student_id(F.col("text")), "student_name": T.student_name(F.col("text")), "r": T.split_code(F.col("text"))})
    ok = lambda c: F.when(F.col("status") == "ok", c)
    rows = rows.withColumn("b", T.merge_blocks(F.col("r.blocks"), F.lit(None).cast("array<string>")))
    return rows.select("batch", "doc", ok(F.col("student_id")).alias("student_id"), ok(F.col("student_name")).alias("student_name"), ok(F.col("r.prose")).alias("text"),
        ok(F.col("b")).alias("blocks"), ok(F.col("b").isNotNull()).alias("has_code"), "status")


DIMS = 256  #: of hashed embeddings: with few cells unlike texts score high
CONTAINED = 0.8  #: share of a text's shingles that stand in another
LEAST = 0.3  #: fused scores below this have no copy direction and cost no marks


def near(docs: DataFrame, weights: DataFrame, embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """(batch, a, b, fused): the pairs of which one similarity is at least ``least`` or one text stands in the other, and for each document, as a = b, its greatest fused scores over all others.

    A fused score is a mean of the two similarities, so all pairs that reach ``least`` are among them; a text stands in another as in ``containment_pairs``. Exact, by tiles of
    both and of the texts' shingles: no candidate of a pair is a row.
    """

    def run(rows: pa.Table, left: tuple[int, int], right: tuple[int, int], ok: np.ndarray, product) -> dict:
        tfidf, semantic = product(right, "_t"), product(right, "_e")
        fused = P.FUSE_TFIDF * tfidf + P.FUSE_SEMANTIC * semantic
        doc = rows["doc"].to_numpy()
        n = rows["n"].to_numpy()
        shorter = np.minimum.outer(n[slice(*left)], n[slice(*right)])
        inside = (shorter > 0) & (product(right, "_g", (True, True)) >= CONTAINED * shorter - 1e-9 * shorter)
        i, j = np.nonzero(ok & ((tfidf >= least - 1e-9) | (semantic >= least - 1e-9) | inside))
        x, y = doc[i + left[0]], doc[j + right[0]]
        value = np.where(ok, fused, -np.inf)
        top, own = np.concatenate([value.max(1), value.max(0)]), np.concatenate([doc[slice(*left)], doc[slice(*right)]])
        some = top > -np.inf
        return {"a": np.concatenate([np.minimum(x, y), own[some]]), "b": np.concatenate([np.maximum(x, y), own[some]]), "fused": np.concatenate([fused[i, j], top[some]])}

    grams = similarity.shingle_hashes(docs, 3).withColumn("n", F.size("at_g").cast("long")).withColumn("weight_g", F.array().cast("array<double>"))
    rows = similarity.with_vectors(grams, {"_t": weights, "_e": products.dense(embeddings)})
    kind = dict(rows.dtypes)["doc"]
    return products.in_tiles(rows, run, f"a {kind}, b {kind}, fused double", kinds=("_t", "_e", "_g"))


def copies(docs: DataFrame) -> DataFrame:
    """(batch, first, doc): of equal texts of a batch, the smallest document and each other one."""
    hashed = docs.select("batch", "doc", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("batch", "h").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    return hashed.join(first.where("n > 1"), ["batch", "h"]).where("doc != first").select("batch", "first", "doc")


def candidates(same: DataFrame, found: DataFrame, blocks: DataFrame) -> DataFrame:
    """(batch, a, b): the pairs of ``near`` and those that share a signature band in their code.

    Of equal texts (``copies``) the smallest document stands for all, and each other is paired with it.
    """
    parts = [
        same.select("batch", F.col("first").alias("a"), F.col("doc").alias("b")),
        found.where("a != b").select("batch", "a", "b"),
        similarity.lsh_candidates(similarity.minhash_signatures(code.token_grams(blocks), k=1)),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def without(rows: DataFrame, same: DataFrame) -> DataFrame:
    return rows.join(same.select("batch", "doc"), ["batch", "doc"], "left_anti")


def _scores(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """Lengths and scores of a cell's pairs."""
    of = lambda kind: products.given(pairs, pa.table({"doc": rows["doc"], "at": rows[f"at{kind}"], "weight": rows[f"weight{kind}"]}))["value"]
    size = dict(zip(rows["doc"].to_pylist(), rows["n"].to_pylist()))
    lengths = {n: pa.array([size.get(d) for d in pairs[c].to_pylist()], pa.int64()) for n, c in (("na", "a"), ("nb", "b"))}
    sides = rows.filter(pc.greater(pc.list_value_length(rows["blocks"]), 0))
    best = code._cell_scores(True)(pairs, sides)["code_score"]
    out = pairs.drop_columns(["ca", "cb"])
    for name, column in (lengths | {"tfidf": of("_t"), "semantic": of("_e"), "code_score": best}).items():
        out = out.append_column(name, column)
    return out


def scored_pairs(docs: DataFrame, pairs: DataFrame, weights: DataFrame, embeddings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(batch, a, b, tfidf, semantic, fused, copy_direction, code_score) of the given pairs, which are shuffled once: all that a score needs of a document goes to the cells of its pairs."""
    rows = docs.select("batch", "doc", F.length("text").cast("long").alias("n"))
    rows = similarity.with_vectors(rows, {"_t": weights, "_e": products.dense(embeddings)})
    side = blocks.groupBy("batch", "doc").agg(F.collect_set("tokens").alias("blocks"))
    rows = rows.join(side, ["batch", "doc"], "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<array<string>>")))
    found = products.in_cells(Scratch(docs.sparkSession, "sides").save(rows), pairs.select("batch", "a", "b"), _scores, "na long, nb long, tfidf double, semantic double, code_score double", 1024)
    found = found.withColumn("fused", scores.fused(F.col("tfidf"), F.col("semantic")))
    return found.select("batch", "a", "b", "tfidf", "semantic", "fused", scores.copy_direction(F.col("fused"), F.col("na"), F.col("nb")).alias("copy_direction"), "code_score")


def process(submissions: DataFrame, folder: str, *, encode=None, model=None, classifier=None, external: DataFrame | None = None, labels: DataFrame | None = None, least: float = LEAST, every_pair: bool = False, batches: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables parsed, pairs, results, risks and, with ``batches``, marks of the submissions' batches.

    Each is written below ``folder`` in partitions by batch and read from there by the next, so a lost executor costs only
    the tasks that were running, and another run replaces the rows of its own batches and no others. Pairs are those of
    ``candidates``, or all of each batch with ``every_pair``; text_sim_max is the greatest over all others of the batch in either case. Embeddings are those of
    ``encode``, as in ``similarity.text_embeddings``, or hashed ones of DIMS cells. ``model`` gives perplexities (the corpus's own bigram model by
    default), which with ``labels`` (doc, y) are calibrated by them, ``classifier`` and ``external`` are those of ``authorship.probability``.
    """
    spark = submissions.sparkSession
    names = Scratch(spark, "names").save(submissions.select("batch").distinct())

    def stage(name: str, rows: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        io.overwrite_batches(rows, path)
        return spark.read.schema(rows.schema).parquet(path).select(*rows.columns).join(F.broadcast(names), "batch", "left_semi")

    parsed = stage("parsed", parse(submissions))
    texts = parsed.where("text is not null").select("batch", "doc", "text")
    scratch = Scratch(spark, "process")
    tokens = scratch.save(texts.select("batch", "doc", T.content_tokens(F.col("text")).alias("tokens")))
    weights = scratch.save(similarity.tfidf_packed(tokens).select("batch", "doc", "at", "weight"))
    embeddings = scratch.save(similarity.text_embeddings(texts, encode) if encode is not None else similarity.hashed_embeddings(tokens, DIMS))
    blocks = scratch.save(code.block_rows(parsed.where("has_code").select("batch", "doc", "blocks")))
    if every_pair:
        best, wanted = None, similarity.pair_grid(texts)
    else:
        same = scratch.save(copies(texts))
        found = scratch.save(near(without(texts, same), weights, embeddings, least))
        best = found.where("a = b").select("batch", "a", "b", "fused", F.lit(None).cast("double").alias("code_score"))
        wanted = stage("candidates", candidates(same, found, blocks))
    pairs = stage("pairs", scored_pairs(texts, wanted, weights, embeddings, blocks))
    signals = authorship.signals(texts, model if model is not None else authorship.BigramModel(texts))
    if labels is not None:
        signals = calibration.calibrated(scratch.save(signals), labels)
    results = authorship.probability(signals, classifier, external).join(texts.select("batch", "doc"), "doc")
    results = stage("results", results)
    maxima = pairs.select("batch", "a", "b", "fused", "code_score")
    best = similarity.max_similarity(maxima if best is None else maxima.unionByName(best), {"fused": "text_sim_max", "code_score": "code_sim_max"})
    risks = stage("risks", marking.score_documents(parsed.where("text is not null"), best, results))
    scratch.keep()
    out = {"parsed": parsed, "pairs": pairs, "results": results, "risks": risks}
    return out | {"marks": stage("marks", marking.mark_batches(risks, batches))} if batches is not None else out
