"""Queries of training sets, metrics and registries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import authorship, calibration, products, similarity, training
from tessera.plans import base, similarity_plans
from tessera.plans.scoring_plans import SIGNALS, _external, _signal_rows
from tessera.plans.text_plans import TOKENS

Q, SQL = {}, {}
C = F.col
_A = base.with_(base.DOCS, base.ANNOTATIONS)
_Y = "y AS (SELECT d.doc, CASE WHEN label IN ('human', 'plagiarized') THEN 0 ELSE 1 END AS y FROM annotations a JOIN docs d ON d.doc = a.doc)"


def _set(s, d):
    return training.training_set(base.annotations(s, d), base.docs(s, d))


Q["h1_training_set"] = lambda s, d: _set(s, d).select("doc", "y")
SQL["h1_training_set"] = _A + ", " + _Y + " SELECT doc, y FROM y"
Q["h2_training_gate"] = lambda s, d: training.gate(_set(s, d))
SQL["h2_training_gate"] = _A + ", " + _Y + " SELECT count(*) AS n, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) >= 20 AND least(count(*) FILTER (y = 0), count(*) FILTER (y = 1)) >= 5 AS ok FROM y"


def _features(s, d):
    return training.clean_features(_set(s, d).select("doc", "y").join(_signal_rows(s, d).drop("batch"), "doc"))


Q["h3_training_features"] = lambda s, d: _features(s, d).select("doc", "y", "perplexity", "burstiness", F.round("stylometric", 6).alias("stylometric"))
SQL["h3_training_features"] = base.with_(base.DOCS, base.ANNOTATIONS, SIGNALS, _Y) + """SELECT y.doc, y, coalesce(perplexity, 0.0) AS perplexity, coalesce(burstiness, 0.0) AS burstiness, round(coalesce(stylometric, 0.0), 6) AS stylometric
FROM y JOIN sig ON sig.doc = y.doc WHERE coalesce(perplexity, 0) <> 0 OR coalesce(burstiness, 0) <> 0 OR coalesce(stylometric, 0) <> 0"""
Q["h4_stratified_split"] = lambda s, d: training.stratified_split(_set(s, d)).select("doc", "y", "is_test")
SQL["h4_stratified_split"] = _A + ", " + _Y + " SELECT doc, y, percent_rank() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(md5('42:' || doc), 1, 8) AS BIGINT), doc) < 0.2 AS is_test FROM y"


def _predicted(s, d):
    split = training.stratified_split(_features(s, d))
    model = training.fit(split.where("not is_test"))
    return model.transform(split).select("doc", "y", "is_test", vector_to_array("probability")[1].alias("p"))


Q["h5_e6_classifier"] = lambda s, d: _predicted(s, d).select("doc", "y", "is_test", F.round("p", 3).alias("p"))


def _blended(s, d):
    """The classifier where every signal is there, else the heuristic, averaged with external scores."""
    rows = _signal_rows(s, d).drop("batch")
    split = training.stratified_split(_features(s, d))
    return authorship.probability(rows, training.fit(split.where("not is_test")), _external(s, d)).select("doc", F.round("ai_prob", 3).alias("ai_prob"), "source")


Q["e6_blended_probability"] = _blended


def _auc(s, d):
    mean, std = training.cross_validated_auc(_features(s, d)) or (None, None)
    mean, std = (None if x is None else float(x) for x in (mean, std))
    return s.createDataFrame([(mean, std)], "mean double, std double").select(F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


Q["h6_cross_validation"] = _auc


def _probabilities(s, d):
    return _set(s, d).select("doc", "y").join(base.ai(s, d).select("doc", C("ai_prob").alias("p")), "doc")


_PROB = "p AS (SELECT y.doc, y, ai_prob AS p FROM y JOIN ai ON ai.doc = y.doc)"
_AP = base.with_(base.DOCS, base.ANNOTATIONS, base.AI)
_CONF = "count(*) FILTER (p >= {t} AND y = 1) AS tp, count(*) FILTER (p >= {t} AND y = 0) AS fp, count(*) FILTER (p < {t} AND y = 0) AS tn, count(*) FILTER (p < {t} AND y = 1) AS fn"
_RATES = """round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in ("accuracy", "precision", "recall", "fpr", "f1", *names)}).drop("tpr")


Q["h7_metrics"] = lambda s, d: _rounded(training.classification_metrics(_probabilities(s, d)), "auc")
SQL["h7_metrics"] = _AP + f""", {_Y}, {_PROB}, c AS (SELECT {_CONF.format(t='0.5')} FROM p), r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM p),
a AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r)
SELECT tp, fp, tn, fn, {_RATES}, round(auc, 6) AS auc FROM c, a"""
Q["h8_confusion"] = lambda s, d: _probabilities(s, d).groupBy((C("doc") % 5).alias("grp")).agg(*training.confusion(C("p") >= 0.6, C("y")))
SQL["h8_confusion"] = _AP + f", {_Y}, {_PROB} SELECT doc % 5 AS grp, {_CONF.format(t='0.6')} FROM p GROUP BY 1"


def _summary(s, d):
    rows = training.feature_summary(base.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rows.select("feature", "n", *(F.round(c, 3).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")))


Q["h9_feature_summary"] = _summary
SQL["h9_feature_summary"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 3) AS mean, round(stddev({c}), 3) AS std, round(min({c}), 3) AS \"min\", round(quantile_cont({c}, 0.25), 3) AS q1, round(quantile_cont({c}, 0.5), 3) AS median, round(quantile_cont({c}, 0.75), 3) AS q3, round(max({c}), 3) AS \"max\" FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)


def _names(s, d):
    """File names of an evaluation set, one for each document: originals and copies by number, in sets by source."""
    k = F.floor(C("doc") / 2).cast("string")
    return base.docs(s, d).select(C("batch").alias("set"), F.concat(F.lit("para_"), F.when(C("doc") % 2 == 0, "orig").otherwise("copy"), F.lit("_"), k, F.lit("_"), "batch").alias("name"))


_NAMES = "f AS (SELECT batch AS st, CASE WHEN doc % 2 = 0 THEN 'orig' ELSE 'copy' END AS role, doc // 2 AS i, 'para_' || CASE WHEN doc % 2 = 0 THEN 'orig' ELSE 'copy' END || '_' || (doc // 2) || '_' || batch AS name FROM docs)"
_LABELLED = """, l AS (SELECT 'para' AS class, x.name AS a, y.name AS b FROM f x JOIN f y ON x.st = y.st AND x.role = 'orig' AND y.role = 'copy' AND x.i = y.i)"""
Q["h10_labelled_pairs"] = lambda s, d: training.labelled_pairs(_names(s, d), "para")
SQL["h10_labelled_pairs"] = base.with_(base.DOCS, _NAMES) + _LABELLED + """, u AS (SELECT 'unrelated' AS class, x.name AS a, y.name AS b FROM f x JOIN f y ON x.st = y.st AND x.role = 'orig' AND (y.role = 'orig' AND x.i < y.i OR y.role = 'copy' AND x.i <> y.i))
SELECT * FROM l UNION ALL SELECT * FROM u"""
Q["h11_threshold_sweep"] = lambda s, d: _rounded(training.threshold_sweep(_probabilities(s, d)))
SQL["h11_threshold_sweep"] = _AP + f", {_Y}, {_PROB}, c AS (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, {_CONF.format(t=t)} FROM p" for t in (0.5, 0.6, 0.7, 0.8)) + f") SELECT threshold, tp, fp, tn, fn, {_RATES} FROM c"
Q["h12_sampled_pairs"] = lambda s, d: training.labelled_pairs(_names(s, d), "para", unrelated=50)
_HASH = "CAST('0x' || substr(md5('42:' || {x}), 1, 8) AS BIGINT)"
SQL["h12_sampled_pairs"] = base.with_(base.DOCS, _NAMES) + _LABELLED + f""", o AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {_HASH.format(x="name")}, name) AS r FROM f),
w AS (SELECT x.name AS a, y.name AS b FROM o x JOIN o y ON x.st = y.st AND y.r - x.r BETWEEN 1 AND 2 AND x.role = 'orig' AND x.i <> y.i ORDER BY {_HASH.format(x="x.name || y.name")}, 1, 2 LIMIT 50)
SELECT * FROM l UNION ALL SELECT 'unrelated', * FROM w"""


def _means(s, d):
    docs = base.docs(s, d)
    rows = docs.select("batch", "doc", F.length("text").alias("n"), C("has_code").alias("c"))
    weighted, scales = similarity.tfidf_tight(docs)
    vectors = {"_s": similarity.sentence_vectors(docs), "_t": weighted, "_e": products.dense(similarity.hashed_embeddings(docs))}
    found = training.shared_means(similarity.with_vectors(rows, vectors), scales)
    return found.select("class", "n", *(F.round(c, 6).alias(c) for c in ("fused", "code_score", "tfidf", "semantic")))


Q["h13_class_means"] = _means
SQL["h13_class_means"] = base.with_(base.DOCS, base.PAIRS, TOKENS, similarity_plans.TFIDF, similarity_plans.HASHED) + """, nrm AS (SELECT doc, sqrt(sum(v * v)) AS n FROM cell GROUP BY 1),
sem AS (SELECT pairs.a, pairs.b, sum(x.v * y.v) / (max(m.n) * max(o.n)) AS semantic FROM pairs JOIN cell x ON x.doc = a JOIN cell y ON y.doc = b AND y.i = x.i JOIN nrm m ON m.doc = a JOIN nrm o ON o.doc = b WHERE m.n > 0 AND o.n > 0 GROUP BY ALL)
SELECT CASE WHEN fused >= 0.7 THEN 'verbatim' WHEN fused >= 0.4 THEN 'paraphrase' ELSE 'unrelated' END AS class, count(*) AS n, round(avg(fused), 6) AS fused, round(avg(code_score), 6) AS code_score,
  round(avg(coalesce(tfidf, 0)), 6) AS tfidf, round(avg(coalesce(semantic, 0)), 6) AS semantic
FROM pairs p LEFT JOIN sims s ON s.a = p.a AND s.b = p.b LEFT JOIN sem m ON m.a = p.a AND m.b = p.b GROUP BY 1"""


def _events(s, d):
    o = base.table(s, d, "orders")
    v = F.concat(F.lit("v"), C("o_orderkey").cast("string"))
    kind = F.when(C("o_orderstatus") == "F", "activated")
    return o.select(v.alias("version"), F.explode(F.array_compact(F.array(F.lit("trained"), kind))).alias("event"), C("o_orderdate").alias("at"))


Q["h14_registry_state"] = lambda s, d: training.registry_state(_events(s, d)).select("version", "is_active")
SQL["h14_registry_state"] = """WITH o AS (SELECT 'v' || o_orderkey AS version, o_orderstatus AS st, o_orderdate AS done FROM orders)
SELECT version, version = (SELECT version FROM o WHERE st = 'F' ORDER BY done DESC, version DESC LIMIT 1) AS is_active FROM o"""
Q["h14_missing_runs"] = lambda s, d: training.missing_runs(_events(s, d).where("event = 'trained'"), _events(s, d).where("event = 'activated'")).select("version")
SQL["h14_missing_runs"] = "SELECT 'v' || o_orderkey AS version FROM orders WHERE o_orderstatus <> 'F'"


def _calibrated(s, d):
    """Signals of all documents on the scales of the thresholds, by curves that the annotations teach."""
    y = training.training_set(base.annotations(s, d), base.docs(s, d)).select("doc", "y")
    found = calibration.calibrated(base.signals(s, d), y)
    return found.select("doc", F.round("perplexity", 4).alias("perplexity"), F.round("burstiness", 4).alias("burstiness"))


def _curve_sql(x: str) -> str:
    """The falling curve as the least, over where a pool may begin, of the greatest mean over where it may end."""
    return f"""{x}b AS (SELECT CAST(floor(ln(greatest({x}, 1.0)) * 4) AS INTEGER) AS bin, count(*) AS n, sum(y) AS ones FROM sig JOIN lab USING (doc) WHERE {x} IS NOT NULL GROUP BY 1),
{x}c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS n, sum(ones) OVER (ORDER BY bin) AS ones, n AS own, ones AS own1 FROM {x}b),
{x}m AS (SELECT i.bin, j.bin AS j, max(CAST(k.ones - j.ones + j.own1 AS DOUBLE) / (k.n - j.n + j.own)) AS m FROM {x}c i JOIN {x}c j ON j.bin <= i.bin JOIN {x}c k ON k.bin >= i.bin GROUP BY ALL),
{x}p AS (SELECT bin, min(m) AS p FROM {x}m GROUP BY 1),
{x}v AS (SELECT s.doc, coalesce(arg_max(p, bin) FILTER (WHERE bin <= CAST(floor(ln(greatest({x}, 1.0)) * 4) AS INTEGER)), arg_min(p, bin)) AS p FROM sig s, {x}p WHERE {x} IS NOT NULL GROUP BY 1)"""


Q["e1_e2_calibrated"] = _calibrated
SQL["e1_e2_calibrated"] = base.with_(base.DOCS, base.SIGNALS, base.ANNOTATIONS, "lab AS (SELECT a.doc, CASE WHEN label IN ('ai_generated', 'mixed') THEN 1 ELSE 0 END AS y FROM annotations a JOIN docs USING (doc))", _curve_sql("perplexity"), _curve_sql("burstiness")) + """
SELECT sig.doc, round(20 + 180 * (1 - x.p), 4) AS perplexity, round(100 * (1 - z.p), 4) AS burstiness FROM sig LEFT JOIN perplexityv x ON x.doc = sig.doc LEFT JOIN burstinessv z ON z.doc = sig.doc"""
