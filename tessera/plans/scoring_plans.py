"""Queries of authorship signals, risk and marking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions import text as T
from tessera.operators import authorship, marking, products, results, similarity
from tessera.plans import base
from tessera.plans.similarity_plans import TFIDF
from tessera.plans.text_plans import SENT, STYLE, TOKENS

Q, SQL = {}, {}
C = F.col
_D = base.with_(base.DOCS)
_R = base.with_(base.DOCS, base.AI, base.RISKS)
_M = base.with_(base.DOCS, base.AI, base.RISKS, base.BATCHES, base.MARKED)


def flagship(s, d):
    """Documents to text pairs to risk to ranking: the share of machine-like style and the closest peer decide."""
    docs = base.docs(s, d)
    none = F.lit(None).cast("double")
    vectors, scales = similarity.tfidf_tight(docs)
    best = products.greatest(vectors, scales=scales)  # the fused score rises with the product
    best = best.select("batch", "doc", scores.fused(C("value"), none).alias("text_sim_max"), none.alias("code_sim_max"))
    ai = docs.select("doc", T.let(T.stylometric(C("text")), lambda x: scores.heuristic_probability(none, none, x)).alias("ai_prob"))
    risk = marking.score_documents(docs.withColumn("has_code", F.lit(False)), best, ai)
    ranked = results.risk_ranking(risk.withColumn("weighted_score", F.round("weighted_score", 5)))
    return ranked.select("batch", "doc", "position", F.round("text_sim_max", 5).alias("text_sim_max"), F.round("ai_prob", 5).alias("ai_prob"), "weighted_score", "risk_level")


Q["flagship_risk_ranking"] = flagship
SQL["flagship_risk_ranking"] = base.with_(base.DOCS, TOKENS, TFIDF, SENT, STYLE) + """, side AS (SELECT a AS doc, 0.4::DOUBLE * tfidf AS f FROM sims UNION ALL SELECT b, 0.4::DOUBLE * tfidf FROM sims),
best AS (SELECT doc, max(f) AS f FROM side GROUP BY 1),
w AS (SELECT d.batch, d.doc, coalesce(f, 0.0) AS t, coalesce(stylometric, 0.0) AS p FROM docs d LEFT JOIN best USING (doc) LEFT JOIN stylometric s ON s.doc = d.doc),
x AS (SELECT *, round(0.55::DOUBLE * p + 0.45::DOUBLE * t, 5) AS weighted_score, 0.55::DOUBLE * p + 0.45::DOUBLE * t AS full_score FROM w)
SELECT batch, doc, CAST(row_number() OVER (PARTITION BY batch ORDER BY weighted_score DESC, doc) AS INTEGER) AS position, round(t, 5) AS text_sim_max, round(p, 5) AS ai_prob, weighted_score,
  CASE WHEN full_score >= 0.7 THEN 'high' WHEN full_score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM x"""

BIGRAM = base.BIGRAM
def _model(s, d):
    return authorship.BigramModel(base.docs(s, d))


Q["e1_perplexity"] = lambda s, d: _model(s, d).perplexity(base.docs(s, d).select("doc", "text"), ["doc"]).withColumn("perplexity", F.round("perplexity", 4))
SQL["e1_perplexity"] = base.with_(base.DOCS, BIGRAM, base.PPL) + " SELECT doc, round(perplexity, 4) AS perplexity FROM ppl"
Q["e2_burstiness"] = lambda s, d: authorship.burstiness(base.docs(s, d), _model(s, d)).withColumn("burstiness", F.round(C("burstiness") / 1000, 4))
SQL["e2_burstiness"] = base.with_(base.DOCS, base.SENT, BIGRAM, base.BURST) + "SELECT doc, round(burstiness / 1000, 4) AS burstiness FROM bst"


_signal_rows = base.signals
SIGNALS = (*base.SIGNALS, """parts AS (SELECT *, least(greatest(1.0::DOUBLE - (perplexity - 20) / 180, 0.0), 1.0) AS p1, least(greatest(1.0::DOUBLE - burstiness / 100, 0.0), 1.0) AS p2 FROM sig),
heur AS (SELECT *, CASE WHEN perplexity IS NULL AND burstiness IS NULL AND stylometric IS NULL THEN 0.0 ELSE
  ((CASE WHEN perplexity IS NULL THEN 0.0 ELSE p1 END) + (CASE WHEN burstiness IS NULL THEN 0.0 ELSE p2 END) + coalesce(stylometric, 0.0))
  / ((perplexity IS NOT NULL)::INT + (burstiness IS NOT NULL)::INT + (stylometric IS NOT NULL)::INT) END AS h FROM parts)""")
_S = base.with_(base.DOCS, SIGNALS)
Q["e5_heuristic"] = lambda s, d: _signal_rows(s, d).select("doc", F.round(scores.heuristic_probability(C("perplexity"), C("burstiness"), C("stylometric")), 6).alias("p"))
SQL["e5_heuristic"] = _S + "SELECT doc, round(h, 6) AS p FROM heur"


def _external(s, d):
    return base.docs(s, d).where("doc % 6 = 0").select("doc", base.share(C("doc"), 31).alias("api_score"))


Q["e7_blend"] = lambda s, d: authorship.probability(_signal_rows(s, d), external=_external(s, d)).select("doc", F.round("ai_prob", 6).alias("ai_prob"), "source")
SQL["e7_blend"] = _S + "SELECT doc, round(CASE WHEN doc % 6 = 0 THEN 0.5::DOUBLE * h + 0.5::DOUBLE * (CAST((doc * 31) % 101 AS DOUBLE) / 100) ELSE h END, 6) AS ai_prob, CASE WHEN doc % 6 = 0 THEN 'fused' ELSE 'local' END AS source FROM heur"
Q["e8_unscored"] = lambda s, d: authorship.unscored(base.docs(s, d), base.ai(s, d).join(base.annotations(s, d), "doc", "left_semi")).select("batch", "doc")
SQL["e8_unscored"] = base.with_(base.DOCS, base.AI, base.ANNOTATIONS) + "SELECT batch, doc FROM docs WHERE doc NOT IN (SELECT doc FROM ai JOIN annotations USING (doc))"
BAND = "CASE WHEN ai_prob IS NULL OR ai_prob < 0.40 THEN 'AUTHENTIC_HUMAN' WHEN ai_prob <= 0.75 THEN 'INCONCLUSIVE_HUMAN_REVIEW_REQUIRED' ELSE 'PROBABLE_SYNTHETIC_GENERATION' END"
Q["e9_confidence_band"] = lambda s, d: base.docs(s, d).join(base.ai(s, d), "doc", "left").groupBy(scores.confidence_band(C("ai_prob")).alias("band")).agg(F.count("*").alias("n"))
SQL["e9_confidence_band"] = base.with_(base.DOCS, base.AI) + f"SELECT {BAND} AS band, count(*) AS n FROM docs LEFT JOIN ai ON ai.doc = docs.doc GROUP BY 1"
Q["e10_band_policy"] = lambda s, d: base.ai(s, d).select("doc", scores.band_policy(C("ai_prob")).alias("p")).select("doc", "p.zone", "p.automated_penalty_allowed")
SQL["e10_band_policy"] = base.with_(base.DOCS, base.AI) + "SELECT doc, CASE WHEN ai_prob < 0.4 THEN 'HUMAN_ZONE' WHEN ai_prob <= 0.75 THEN 'ESL_QUARANTINE_ZONE' ELSE 'SYNTHETIC_AI_ZONE' END AS zone, ai_prob > 0.75 AS automated_penalty_allowed FROM ai"
Q["e11_cross_perplexity"] = lambda s, d: _signal_rows(s, d).select("doc", F.round(scores.cross_perplexity(C("perplexity")), 6).alias("score"))
SQL["e11_cross_perplexity"] = _S + "SELECT doc, round(CASE WHEN perplexity > 0 THEN 1.15::DOUBLE * ln(greatest(perplexity, 1.0001)) / perplexity END, 6) AS score FROM sig"


def _assessed(s, d):
    rows = _signal_rows(s, d).join(base.risks(s, d).select("doc", "text_sim_max", "ai_prob"), "doc").join(base.marked(s, d).select("doc", (C("marks_obtained") / C("total_marks") * 100).alias("pct")), "doc", "left")
    return rows.select("doc", scores.signal_assessments(C("perplexity"), C("burstiness"), C("ai_prob"), C("text_sim_max"), C("pct")).alias("a")).select("doc", "a.*")


Q["e12_signal_assessments"] = _assessed
SQL["e12_signal_assessments"] = base.with_(base.DOCS, SIGNALS, base.RISKS, base.BATCHES, base.MARKED) + """SELECT s.doc,
  CASE WHEN coalesce(perplexity, 0) <= 0 THEN 'indeterminate' WHEN perplexity < 28 THEN 'synthetic' WHEN perplexity < 55 THEN 'borderline' ELSE 'human' END AS perplexity,
  CASE WHEN coalesce(burstiness, 0) <= 0 THEN 'indeterminate' WHEN burstiness < 12 THEN 'uniform' WHEN burstiness < 22 THEN 'mixed' ELSE 'natural' END AS burstiness,
  CASE WHEN ai_prob < 0.30 THEN 'AUTHENTIC HUMAN' WHEN ai_prob <= 0.65 THEN 'HUMAN AUDIT REQUIRED' ELSE 'PROBABLE SYNTHETIC' END AS ai_band,
  CASE WHEN round(text_sim_max * 100) < 25 THEN 'LOW / CLEAN' WHEN round(text_sim_max * 100) < 50 THEN 'MODERATE' ELSE 'HIGH MATCH' END AS similarity,
  CASE WHEN round(ai_prob * 100) < 30 THEN 'HUMAN AUTHORED' WHEN round(ai_prob * 100) < 65 THEN 'MIXED HUMAN/AI' ELSE 'AI GENERATED' END AS ai_card,
  CASE WHEN marks_obtained IS NULL THEN NULL WHEN marks_obtained / m.total_marks * 100 < 50 THEN 'poor' WHEN marks_obtained / m.total_marks * 100 < 70 THEN 'fair' ELSE 'good' END AS marks
FROM sig s JOIN risks r ON r.doc = s.doc LEFT JOIN marked m ON m.doc = s.doc"""

Q["f1_max_similarity"] = lambda s, d: base.docs(s, d).select("batch", "doc").join(base.best(s, d), ["batch", "doc"], "left").fillna(0.0)
SQL["f1_max_similarity"] = base.with_(base.DOCS, base.PAIRS) + """, u AS (SELECT a AS doc, fused, code_score FROM pairs UNION ALL SELECT b, fused, code_score FROM pairs), m AS (SELECT doc, max(fused) AS f, max(code_score) AS c FROM u GROUP BY 1)
SELECT batch, d.doc, coalesce(f, 0.0) AS text_sim_max, CAST(coalesce(c, 0.0) AS DOUBLE) AS code_sim_max FROM docs d LEFT JOIN m ON m.doc = d.doc"""
Q["f2_f3_risk"] = lambda s, d: base.risks(s, d).select("doc", F.round("weighted_score", 6).alias("weighted_score"), "code_sim_max", "weight_profile", "risk_level")
SQL["f2_f3_risk"] = _R + "SELECT doc, round(weighted_score, 6) AS weighted_score, code_sim_max, weight_profile, risk_level FROM risks"


def _upserted(s, d):
    r = base.risks(s, d).select("doc", "weighted_score", "risk_level")
    return marking.upsert(r.where("doc % 2 = 0"), r.where("doc % 3 = 0").withColumns({"weighted_score": F.lit(1.0), "risk_level": F.lit(None).cast("string")}), ["doc"])


Q["f4_upsert_risk"] = lambda s, d: _upserted(s, d).withColumn("weighted_score", F.round("weighted_score", 6))
SQL["f4_upsert_risk"] = _R + "SELECT doc, round(CASE WHEN doc % 3 = 0 THEN 1.0 ELSE weighted_score END, 6) AS weighted_score, CASE WHEN doc % 2 = 0 THEN risk_level END AS risk_level FROM risks WHERE doc % 2 = 0 OR doc % 3 = 0"
Q["f5_f6_marks"] = lambda s, d: base.marked(s, d)
SQL["f5_f6_marks"] = _M + "SELECT batch, doc, total_marks, marks_obtained, ai_deduction, text_copy_deduction, code_ast_deduction, risk_score_deduction, confidence_band, total_deductions FROM marked"
Q["f7_mark_batches"] = lambda s, d: base.marked(s, d).groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg("marks_obtained"), 4).alias("mean"))
SQL["f7_mark_batches"] = _M + "SELECT batch, count(*) AS n, round(avg(marks_obtained), 4) AS mean FROM marked GROUP BY 1"
Q["f8_ramp_marks"] = lambda s, d: base.risks(s, d).select("doc", scores.ramp_marks(F.lit(100.0), C("ai_prob"), C("text_sim_max"), C("code_sim_max")).alias("r")).select("doc", "r.level", "r.profile", F.floor("r.final_mark").alias("whole"))
SQL["f8_ramp_marks"] = _R + """, m AS (SELECT doc, code_sim_max IS NOT NULL AND code_sim_max > 0.05 AS has, ai_prob, text_sim_max, code_sim_max FROM risks),
k AS (SELECT *, CASE WHEN has THEN 0.40::DOUBLE * ai_prob + 0.35::DOUBLE * text_sim_max + 0.25::DOUBLE * code_sim_max ELSE 0.55::DOUBLE * ai_prob + 0.45::DOUBLE * text_sim_max END AS s,
  (CASE WHEN ai_prob > 0.75 THEN (ai_prob - 0.75) / 0.25 * 30.0 ELSE 0 END) + (CASE WHEN text_sim_max > 0.30 THEN (text_sim_max - 0.30) / 0.70 * 40.0 ELSE 0 END) + (CASE WHEN code_sim_max > 0.35 THEN (code_sim_max - 0.35) / 0.65 * 50.0 ELSE 0 END) AS d FROM m)
SELECT doc, CASE WHEN s < 0.30 THEN 'LOW' WHEN s < 0.70 THEN 'MEDIUM' ELSE 'HIGH' END AS level, CASE WHEN has THEN 'CODE_PRESENT' ELSE 'TEXT_ONLY' END AS profile, CAST(floor(greatest(0.0, round(100.0 - d, 1))) AS BIGINT) AS whole FROM k"""


def _saved(s, d):
    o = base.table(s, d, "orders")
    return o.select(
        C("o_orderkey").alias("config_id"), F.concat(F.lit("u"), (C("o_custkey") % 50).cast("string")).alias("user"), F.concat(F.lit("cfg"), C("o_orderkey").cast("string")).alias("config_json"),
        (C("o_orderpriority") == "1-URGENT").alias("is_default"), C("o_orderdate").alias("created_at"),
    )


SAVED = "saved AS (SELECT o_orderkey AS config_id, 'u' || (o_custkey % 50) AS \"user\", 'cfg' || o_orderkey AS config_json, o_orderpriority = '1-URGENT' AS is_default, o_orderdate AS created_at FROM orders)"


def _resolved(s, d):
    saved = marking.single_default(_saved(s, d))
    k = C("c_custkey")
    req = base.table(s, d, "customer").select(k.alias("request"), F.concat(F.lit("u"), (k % 60).cast("string")).alias("user"), F.when(k % 5 == 0, F.concat(F.lit("own"), k.cast("string"))).alias("config_json"), F.when(k % 2 == 0, k).alias("chosen_id"))
    return marking.resolve_config(req.withColumnRenamed("chosen_id", "config_id"), saved)


Q["f9_resolve_config"] = _resolved
SQL["f9_resolve_config"] = base.with_(SAVED) + """, dflt AS (SELECT "user", config_json FROM saved WHERE is_default QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY created_at DESC, config_id DESC) = 1),
req AS (SELECT c_custkey AS request, 'u' || (c_custkey % 60) AS "user", CASE WHEN c_custkey % 5 = 0 THEN 'own' || c_custkey END AS own, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS chosen FROM customer)
SELECT request, req."user", coalesce(own, s.config_json, d.config_json) AS config_json FROM req LEFT JOIN saved s ON s.config_id = chosen AND s."user" = req."user" LEFT JOIN dflt d ON d."user" = req."user\""""


def _config_checks(s, d):
    low = (C("doc") % 130).cast("string")
    json = F.concat(F.lit('{"total_marks": '), (C("doc") % 4).cast("string"), F.lit(', "ai_thresholds": [{"min_value": '), low, F.lit(', "max_value": 100, "marks_deduct": 5}], "extra": 1}'))
    return base.docs(s, d).select("doc", F.array_join(marking.config_errors(marking.parse_config(json)), ",").alias("errors"))


Q["f10_validate_config"] = _config_checks
SQL["f10_validate_config"] = _D + "SELECT doc, concat_ws(',', CASE WHEN doc % 4 = 0 THEN 'total_marks' END, CASE WHEN doc % 130 > 100 THEN 'ai_thresholds' END) AS errors FROM docs"
Q["f11_single_default"] = lambda s, d: marking.single_default(_saved(s, d)).select("config_id", "user", "is_default", "place")
SQL["f11_single_default"] = base.with_(SAVED) + """, one AS (SELECT *, is_default AND row_number() OVER (PARTITION BY "user", is_default ORDER BY created_at DESC, config_id DESC) = 1 AS d FROM saved)
SELECT config_id, "user", d AS is_default, CAST(row_number() OVER (PARTITION BY "user" ORDER BY d DESC, created_at DESC, config_id DESC) AS INTEGER) AS place FROM one"""
Q["f12_rubric_rows"] = lambda s, d: marking.rubric_rows(base.batches(s, d))
SQL["f12_rubric_rows"] = base.with_(base.BATCHES) + """, t(category, pos, label, min_value, max_value, marks_deduct) AS (VALUES ('ai_thresholds', 0, 'AI Probability', 0, 40, 0), ('ai_thresholds', 1, NULL, 40, 100, 20),
  ('text_copy_thresholds', 0, 'Text Similarity', 50, 75, 10), ('text_copy_thresholds', 1, NULL, 75, 100, 25), ('code_ast_thresholds', 0, 'Code Similarity', 60, 100, 15), ('risk_score_thresholds', 0, 'Risk Score', 70, 100, 5))
SELECT batch, category, pos, label, CAST(min_value AS DOUBLE) AS min_value, CAST(max_value AS DOUBLE) AS max_value, CAST(marks_deduct AS DOUBLE) AS marks_deduct FROM batches, t WHERE total_marks IS NOT NULL"""
Q["f13_penalty_rows"] = lambda s, d: marking.penalty_rows(base.marked(s, d))
SQL["f13_penalty_rows"] = _M + """, u AS (SELECT batch, doc, unnest([{'item': 'base', 'amount': total_marks, 'k': 0}, {'item': 'ai', 'amount': ai_deduction, 'k': 1}, {'item': 'text_copy', 'amount': text_copy_deduction, 'k': 1},
  {'item': 'code_ast', 'amount': code_ast_deduction, 'k': 1}, {'item': 'risk_score', 'amount': risk_score_deduction, 'k': 1}, {'item': 'final', 'amount': marks_obtained, 'k': 0}, {'item': 'percent', 'amount': round(marks_obtained / total_marks * 100, 1), 'k': 0}]) AS u FROM marked)
SELECT batch, doc, u.item, u.amount, CASE WHEN u.k = 0 THEN '' WHEN u.amount > 0 THEN 'Flagged' ELSE 'Pass' END AS status FROM u"""
