"""Scores, bands and deductions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import params as P


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rounded(c: Column, digits: int = 0) -> Column:
    """A double from 0 on rounded half up after it is multiplied by the power of ten, as SQL engines and C do; ``F.round`` rounds its shortest decimal text."""
    x = c * float(10**digits)
    low = F.floor(x)
    return (low + (x - low >= 0.5).cast("int")) / float(10**digits)


def fused(tfidf: Column, semantic: Column) -> Column:
    zero = F.lit(0.0)
    return F.lit(P.FUSE_TFIDF) * F.coalesce(tfidf, zero) + F.lit(P.FUSE_SEMANTIC) * F.coalesce(semantic, zero)


def copy_direction(score: Column, len_a: Column, len_b: Column) -> Column:
    """Unknown below 0.3, mutual if the lengths differ by less than 2 percent, else from the shorter to the longer."""
    near = F.abs(len_a - len_b) < 0.02 * F.greatest(len_a, len_b)
    return F.when(score < 0.3, "unknown").when(near, "mutual").when(len_a < len_b, "a_to_b").otherwise("b_to_a")


def heuristic_probability(perplexity: Column, burstiness: Column, stylometric: Column) -> Column:
    """Mean of the signals that are there."""
    parts = [clip(1.0 - (perplexity - 20) / 180), clip(1.0 - burstiness / 100), stylometric]
    parts = [F.when(c.isNotNull(), p) for c, p in zip((perplexity, burstiness, stylometric), parts)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return clip(F.when(n > 0, total / n).otherwise(0.0))


def blended(local: Column, external: Column) -> tuple[Column, Column]:
    """Probability and source with an external score where there is one."""
    both = F.lit(P.BLEND_LOCAL) * local + F.lit(P.BLEND_EXTERNAL) * external
    return clip(F.when(external.isNotNull(), both).otherwise(local)), F.when(external.isNotNull(), "fused").otherwise("local")


def confidence_band(ai: Column) -> Column:
    return (
        F.when(ai.isNull() | (ai < P.BAND_LOW), "AUTHENTIC_HUMAN")
        .when(ai <= P.BAND_HIGH, "INCONCLUSIVE_HUMAN_REVIEW_REQUIRED")
        .otherwise("PROBABLE_SYNTHETIC_GENERATION")
    )


def band_policy(ai: Column) -> Column:
    """Struct (zone, automated_penalty_allowed, action). The zones' names and what is to be done."""
    row = lambda zone, allowed, action: F.struct(F.lit(zone).alias("zone"), F.lit(allowed).alias("automated_penalty_allowed"), F.lit(action).alias("action"))
    return (
        F.when(ai < P.BAND_LOW, row("HUMAN_ZONE", False, "Pass without penalty. High confidence authentic."))
        .when(ai <= P.BAND_HIGH, row("ESL_QUARANTINE_ZONE", False, "AUTOMATED DEDUCTIONS PROHIBITED. Flagged for manual faculty review."))
        .otherwise(row("SYNTHETIC_AI_ZONE", True, "Automated rubric deduction applied per institutional threshold."))
    )


def cross_perplexity(perplexity: Column) -> Column:
    return F.when(perplexity > 0, 1.15 * F.log(F.greatest(perplexity, F.lit(1.0001))) / perplexity)


def risk(has_code: Column, text: Column, code: Column, ai: Column) -> Column:
    """Struct (weighted_score, code_sim_max, weight_profile); a missing probability counts as 0."""
    zero = F.lit(0.0)
    a, t = F.coalesce(ai, zero), F.coalesce(text, zero)
    c = F.coalesce(code, zero)
    w = P.WEIGHTS_CODE
    with_code = F.struct((w["ai"] * a + w["text"] * t + w["code"] * c).alias("weighted_score"), c.alias("code_sim_max"), F.lit("code_present").alias("weight_profile"))
    w = P.WEIGHTS_THEORY
    theory = F.struct((w["ai"] * a + w["text"] * t).alias("weighted_score"), F.lit(None).cast("double").alias("code_sim_max"), F.lit("theory_only").alias("weight_profile"))
    return F.when(F.coalesce(has_code, F.lit(False)), with_code).otherwise(theory)


def risk_level(score: Column) -> Column:
    return F.when(score >= P.RISK_HIGH, "high").when(score >= P.RISK_MEDIUM, "medium").otherwise("low")


THRESHOLDS = "array<struct<min_value:double,max_value:double,marks_deduct:double>>"
CONFIG = (
    f"struct<total_marks:double,ai_thresholds:{THRESHOLDS},text_copy_thresholds:{THRESHOLDS},"
    f"code_ast_thresholds:{THRESHOLDS},risk_score_thresholds:{THRESHOLDS},enforce_esl_equity:boolean>"
)


def deduction(percent: Column, thresholds: Column) -> Column:
    """The first threshold in list order that holds the value, both ends included; none gives 0."""
    hit = F.try_element_at(F.filter(thresholds, lambda t: (t["min_value"] <= percent) & (percent <= t["max_value"])), F.lit(1))
    return F.coalesce(hit["marks_deduct"], F.lit(0.0))


def marks(total: Column, config: Column, ai: Column, text: Column, code: Column, weighted: Column) -> Column:
    """Struct of marks_obtained and the breakdown; without a config all marks and nulls.

    The inconclusive band takes no automatic deduction for the probability unless the config says so.
    """
    pct = lambda c: F.coalesce(c, F.lit(0.0)) * 100
    band = confidence_band(ai)
    fair = F.coalesce(config["enforce_esl_equity"], F.lit(True))
    d_ai = F.when((band == "INCONCLUSIVE_HUMAN_REVIEW_REQUIRED") & fair, 0.0).otherwise(deduction(pct(ai), config["ai_thresholds"]))
    parts = [d_ai, deduction(pct(text), config["text_copy_thresholds"]), deduction(pct(code), config["code_ast_thresholds"]), deduction(pct(weighted), config["risk_score_thresholds"])]
    names = ["ai_deduction", "text_copy_deduction", "code_ast_deduction", "risk_score_deduction"]
    sum_ = parts[0] + parts[1] + parts[2] + parts[3]
    is_set = config.isNotNull()
    of = lambda c: F.when(is_set, c)
    return F.struct(
        F.when(is_set, F.greatest(F.lit(0.0), total - sum_)).otherwise(total).alias("marks_obtained"),
        *(of(p).alias(n) for p, n in zip(parts, names)),
        of(band).alias("confidence_band"),
        of(sum_).alias("total_deductions"),
    )


def ramp_marks(max_marks: Column, ai: Column, text: Column, code: Column) -> Column:
    """The other policy: deductions grow linearly from 0.75, 0.30 and 0.35."""
    d_ai = F.when(band_policy(ai)["automated_penalty_allowed"] & (ai > 0.75), (ai - 0.75) / 0.25 * 30.0).otherwise(0.0)
    d_text = F.when(text > 0.30, (text - 0.30) / 0.70 * 40.0).otherwise(0.0)
    d_code = F.when(code > 0.35, (code - 0.35) / 0.65 * 50.0).otherwise(0.0)
    has = code.isNotNull() & (code > 0.05)
    score = clip(F.when(has, 0.40 * ai + 0.35 * text + 0.25 * code).otherwise(0.55 * ai + 0.45 * text))
    total = d_ai + d_text + d_code
    return F.struct(
        F.round(score, 3).alias("risk"),
        F.when(score < 0.30, "LOW").when(score < 0.70, "MEDIUM").otherwise("HIGH").alias("level"),
        F.when(has, "CODE_PRESENT").otherwise("TEXT_ONLY").alias("profile"),
        F.round(total, 1).alias("total_deductions"),
        rounded(F.greatest(F.lit(0.0), max_marks - total), 1).alias("final_mark"),
    )


def buckets(value: Column, cuts: list[tuple[float, str]], above: str, inclusive: bool = False) -> Column:
    """The first label whose cut lies above the value (or at it, if inclusive)."""
    out = None
    for cut, label in cuts:
        test = value <= cut if inclusive else value < cut
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(above)


def signal_assessments(ppl: Column, burst: Column, ai: Column, text: Column, marks_pct: Column) -> Column:
    """Struct of the labels a report gives to each signal."""
    ppl, burst, ai, text = (F.coalesce(c, F.lit(0.0)) for c in (ppl, burst, ai, text))
    return F.struct(
        F.when(ppl <= 0, "indeterminate").otherwise(buckets(ppl, [(28.0, "synthetic"), (55.0, "borderline")], "human")).alias("perplexity"),
        F.when(burst <= 0, "indeterminate").otherwise(buckets(burst, [(12.0, "uniform"), (22.0, "mixed")], "natural")).alias("burstiness"),
        F.when(ai < 0.30, "AUTHENTIC HUMAN").when(ai <= 0.65, "HUMAN AUDIT REQUIRED").otherwise("PROBABLE SYNTHETIC").alias("ai_band"),
        buckets(F.round(text * 100), [(25, "LOW / CLEAN"), (50, "MODERATE")], "HIGH MATCH").alias("similarity"),
        buckets(F.round(ai * 100), [(30, "HUMAN AUTHORED"), (65, "MIXED HUMAN/AI")], "AI GENERATED").alias("ai_card"),
        F.when(marks_pct.isNotNull(), buckets(marks_pct, [(50, "poor"), (70, "fair")], "good")).alias("marks"),
    )
