"""Rubrics: resolving, checking and flattening configs, marking batches, keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scores

CATEGORIES = {
    "ai_thresholds": "AI Probability",
    "text_copy_thresholds": "Text Similarity",
    "code_ast_thresholds": "Code Similarity",
    "risk_score_thresholds": "Risk Score",
}


def score_documents(docs: DataFrame, similarity: DataFrame, ai: DataFrame) -> DataFrame:
    """(batch, doc, has_code, text_sim_max, code_sim_max, ai_prob, weighted_score, risk_level, weight_profile) of every document."""
    zero = F.lit(0.0)
    rows = docs.select("batch", "doc", "has_code").join(similarity, ["batch", "doc"], "left").join(ai.select("doc", "ai_prob"), "doc", "left")
    rows = rows.withColumns({"text_sim_max": F.coalesce("text_sim_max", zero), "ai_prob": F.coalesce("ai_prob", zero)})
    rows = rows.withColumn("r", scores.risk(F.col("has_code"), F.col("text_sim_max"), F.col("code_sim_max"), F.col("ai_prob")))
    return rows.select("batch", "doc", "has_code", "text_sim_max", "r.code_sim_max", "ai_prob", "r.weighted_score", scores.risk_level(F.col("r.weighted_score")).alias("risk_level"), "r.weight_profile")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: new values where there are any, else the old ones. Rows of ``new`` that share a key must agree."""
    values = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values))


def mark_batches(risks: DataFrame, batches: DataFrame) -> DataFrame:
    """Marks of every scored document in the batches that have total marks and a config."""
    ready = batches.where("total_marks is not null and config is not null").select("batch", "total_marks", "config")
    rows = risks.join(ready, "batch")
    m = scores.marks(F.col("total_marks"), F.col("config"), F.col("ai_prob"), F.col("text_sim_max"), F.col("code_sim_max"), F.col("weighted_score"))
    return rows.withColumn("m", m).select("batch", "doc", "total_marks", "m.*")


def parse_config(json: Column) -> Column:
    return F.from_json(json, scores.CONFIG)


def config_errors(config: Column) -> Column:
    """What is wrong with a config, as an array of strings; empty if nothing is."""
    bad = lambda t: t["min_value"].isNull() | t["max_value"].isNull() | (t["min_value"] < 0) | (t["max_value"] > 100) | (t["min_value"] > t["max_value"]) | (t["marks_deduct"] < 0)
    tests = [F.when(F.coalesce(config["total_marks"], F.lit(0.0)) <= 0, "total_marks")]
    tests += [F.when(F.coalesce(F.exists(config[c], bad), F.lit(False)), c) for c in CATEGORIES]
    return F.array_compact(F.array(*tests))


def resolve_config(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """(request, user, config_json): the request's own, else the chosen saved one of the same user, else the user's default."""
    chosen = saved.select(F.col("config_id").alias("chosen_id"), F.col("user").alias("chosen_user"), F.col("config_json").alias("chosen_json"))
    default = saved.where("is_default").select("user", F.col("config_json").alias("default_json"))
    rows = requests.join(chosen, (F.col("chosen_id") == F.col("config_id")) & (F.col("chosen_user") == F.col("user")), "left").join(default, "user", "left")
    return rows.select("request", "user", F.coalesce("config_json", "chosen_json", "default_json").alias("config_json"))


def single_default(saved: DataFrame) -> DataFrame:
    """Of each user's configs marked as default only the latest stays so; listed default first, then newest."""
    rank = F.row_number().over(Window.partitionBy("user", "is_default").orderBy(F.desc("created_at"), F.desc("config_id")))
    rows = saved.withColumn("is_default", F.col("is_default") & (rank == 1))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("is_default"), F.desc("created_at"), F.desc("config_id")))
    return rows.withColumn("place", place)


def rubric_rows(batches: DataFrame) -> DataFrame:
    """(batch, category, pos, label, min_value, max_value, marks_deduct): the label on a category's first row only."""
    out = None
    for column, label in CATEGORIES.items():
        rows = batches.select("batch", F.lit(column).alias("category"), F.posexplode(f"config.{column}").alias("pos", "t"))
        rows = rows.select("batch", "category", "pos", F.when(F.col("pos") == 0, label).alias("label"), "t.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def penalty_rows(marked: DataFrame) -> DataFrame:
    """(batch, doc, item, amount, status): one row for each of a document's four penalties, then base and final marks."""
    item = lambda name, c: F.struct(F.lit(name).alias("item"), c.alias("amount"), F.when(c > 0, "Flagged").otherwise("Pass").alias("status"))
    total = lambda name, c: F.struct(F.lit(name).alias("item"), c.alias("amount"), F.lit("").alias("status"))
    rows = F.array(
        total("base", F.col("total_marks")),
        *(item(n, F.col(f"{n}_deduction")) for n in ("ai", "text_copy", "code_ast", "risk_score")),
        total("final", F.col("marks_obtained")),
        total("percent", F.round(F.col("marks_obtained") / F.col("total_marks") * 100, 1)),
    )
    return marked.select("batch", "doc", F.inline(rows))
