"""Queries of text and code similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions import text as T
from tessera.operators import code, processing, products, similarity
from tessera.params import STOP_WORDS, TfidfParams
from tessera.plans import base
from tessera.plans.text_plans import SENT, TOKENS
from tessera.scratch import Scratch
from tessera.session import shared_dir

Q, SQL = {}, {}
C = F.col
_D = base.with_(base.DOCS)

TFIDF = """words AS (SELECT batch, doc, list_filter(w, lambda x: length(x) >= 2) AS w FROM tok),
grams AS (SELECT batch, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT batch, doc, term, count(*) AS tf FROM grams GROUP BY ALL),
byterm AS (SELECT batch, term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY cf DESC, term) AS r FROM byterm QUALIFY r <= 10000),
nd AS (SELECT batch, count(*) AS n FROM docs GROUP BY 1),
raw AS (SELECT tf.batch, doc, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN kept USING (batch, term) JOIN nd USING (batch)),
vec AS (SELECT batch, doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY batch, doc)) AS weight FROM raw),
sims AS (SELECT x.batch, x.doc AS a, y.doc AS b, sum(x.weight * y.weight) AS tfidf FROM vec x JOIN vec y ON x.batch = y.batch AND x.term = y.term AND x.doc < y.doc GROUP BY ALL)"""
_T = base.with_(base.DOCS, TOKENS, TFIDF)


def _vectors(s, d):
    return similarity.tfidf_packed(base.docs(s, d))


def _tight(s, d):
    return similarity.tfidf_tight(base.docs(s, d))


def _tfidf(s, d):
    vectors, scales = _tight(s, d)
    return similarity.tfidf_pairs(vectors, scales=scales)


Q["c1_tfidf_vectors"] = lambda s, d: _vectors(s, d).select("batch", "doc", F.size("at").cast("long").alias("n_terms"), F.round(F.aggregate("weight", F.lit(0.0), lambda t, w: t + w), 4).alias("total"))
SQL["c1_tfidf_vectors"] = _T + "SELECT batch, doc, count(*) AS n_terms, round(sum(weight), 4) AS total FROM vec GROUP BY ALL"
Q["c2_tfidf_pairs"] = lambda s, d: _tfidf(s, d).withColumn("tfidf", F.round("tfidf", 5))
SQL["c2_tfidf_pairs"] = _T + "SELECT batch, a, b, round(tfidf, 5) AS tfidf FROM sims"


def _vec(s, d):
    return base.table(s, d, "embeddings").select(C("label").alias("batch"), C("vec_id").alias("doc"), "embedding")


Q["c3_embedding_pairs"] = lambda s, d: similarity.embedding_pairs(_vec(s, d)).withColumn("semantic", F.round("semantic", 5))
SQL["c3_embedding_pairs"] = """SELECT x.label AS batch, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 5) AS semantic
FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id"""

HASHED = """num AS (SELECT doc, unnest(w) AS t FROM tok), place AS (SELECT doc, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM num),
cell AS (SELECT doc, h % 32 AS i, sum(1 - 2 * ((h // 32) % 2)) AS v FROM place GROUP BY ALL)"""
Q["c4_text_embedding"] = lambda s, d: similarity.hashed_embeddings(base.docs(s, d)).select("doc", F.posexplode("embedding").alias("i", "v")).where("v != 0").select("doc", C("i").cast("long").alias("i"), F.round("v", 6).alias("v"))
SQL["c4_text_embedding"] = base.with_(base.DOCS, TOKENS, HASHED) + ", n AS (SELECT doc, sqrt(sum(v * v)) AS n FROM cell GROUP BY 1) SELECT doc, i, round(v / n, 6) AS v FROM cell JOIN n USING (doc) WHERE v <> 0"

Q["c5_c7_score_pairs"] = lambda s, d: (
    similarity.score_all_pairs(base.docs(s, d), *_tight(s, d)).select("batch", "a", "b", F.round("fused", 5).alias("fused"), "copy_direction")
)
SQL["c5_c7_score_pairs"] = _T + """, g AS (SELECT x.batch, x.doc AS a, y.doc AS b, length(x.text) AS na, length(y.text) AS nb FROM docs x JOIN docs y ON x.batch = y.batch AND x.doc < y.doc),
f AS (SELECT g.*, 0.4::DOUBLE * coalesce(tfidf, 0) AS fused FROM g LEFT JOIN sims USING (batch, a, b))
SELECT batch, a, b, round(fused, 5) AS fused, CASE WHEN fused < 0.3 THEN 'unknown' WHEN abs(na - nb) < 0.02 * greatest(na, nb) THEN 'mutual' WHEN na < nb THEN 'a_to_b' ELSE 'b_to_a' END AS copy_direction FROM f"""


def _grid_sums(s, d):
    """The check sum is a BIGINT, as in the SQL, unless one is more than that holds, where the SQL's own cast fails: then DECIMAL(38, 0). Products are added up in two halves, of which neither overflows."""
    product, half = C("a") * C("b"), 1 << 32
    sums = similarity.pair_grid(base.docs(s, d)).groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.shiftright(product, 32)).alias("high"), F.sum(product.bitwiseAND(F.lit(half - 1))).alias("low"))
    whole = C("high").cast("decimal(28,0)") * F.lit(half).cast("decimal(10,0)") + C("low")
    rows = Scratch(s, "grid").save(sums.select("batch", "n", whole.cast("decimal(38,0)").alias("check_sum")))
    fits = rows.where(F.abs("check_sum") > F.lit((1 << 63) - 1).cast("decimal(38,0)")).isEmpty()
    return rows.withColumn("check_sum", C("check_sum").cast("bigint")) if fits else rows


Q["c6_pair_grid"] = _grid_sums
SQL["c6_pair_grid"] = _D + "SELECT x.batch, count(*) AS n, CAST(sum(x.doc * y.doc) AS BIGINT) AS check_sum FROM docs x JOIN docs y ON x.batch = y.batch AND x.doc < y.doc GROUP BY 1"

_PERM = "perm(i, a, b) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, a, b in similarity.permutations()) + ")"
_GRAMS = r"""sh AS (SELECT batch, doc, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM docs),
hx AS (SELECT batch, doc, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS x FROM (SELECT DISTINCT batch, doc, unnest(list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))) AS g FROM sh)),
sg AS (SELECT batch, doc, i, min((a * x + b) % 2147483647) AS m FROM hx, perm GROUP BY ALL)"""
_S = base.with_(base.DOCS, _PERM, _GRAMS)


def _signatures(s, d):
    return similarity.minhash_signatures(base.docs(s, d))


Q["c8_minhash"] = lambda s, d: _signatures(s, d).select("batch", "doc", F.posexplode("signature").alias("i", "m")).groupBy("batch", "doc").agg(F.sum((C("i") + 1) * (C("m") % 1000003)).alias("check_sum"))
SQL["c8_minhash"] = _S + "SELECT batch, doc, CAST(sum((i + 1) * (m % 1000003)) AS BIGINT) AS check_sum FROM sg GROUP BY ALL"
Q["c9_lsh_pairs"] = lambda s, d: similarity.lsh_candidates(_signatures(s, d))  # pairs of representatives, and each copy with its own


SQL["c9_lsh_pairs"] = _S + """, band AS (SELECT batch, doc, i // 4 AS band, list(m ORDER BY i) AS k FROM sg GROUP BY ALL),
whole AS (SELECT batch, doc, list(m ORDER BY i) AS k FROM sg GROUP BY ALL), rep AS (SELECT batch, k, min(doc) AS doc FROM whole GROUP BY batch, k)
SELECT DISTINCT x.batch, x.doc AS a, y.doc AS b FROM band x JOIN band y ON x.batch = y.batch AND x.band = y.band AND x.k = y.k AND x.doc < y.doc
JOIN rep p ON p.batch = x.batch AND p.doc = x.doc JOIN rep q ON q.batch = y.batch AND q.doc = y.doc
UNION SELECT w.batch, r.doc, w.doc FROM whole w JOIN rep r ON r.batch = w.batch AND r.k = w.k WHERE r.doc <> w.doc"""


def _estimates(s, d):
    sig = _signatures(s, d)
    rows = Q["c9_lsh_pairs"](s, d).join(sig.select(C("doc").alias("a"), C("signature").alias("sa")), "a").join(sig.select(C("doc").alias("b"), C("signature").alias("sb")), "b")
    est = similarity.jaccard_estimate(C("sa"), C("sb"))
    return rows.select("batch", "a", "b", F.round(est, 6).alias("estimate"), F.round(similarity.candidate_probability(est), 6).alias("probability"))


Q["c10_jaccard_estimate"] = _estimates
SQL["c10_jaccard_estimate"] = "WITH c AS (" + SQL["c9_lsh_pairs"] + "),\n" + _S.removeprefix("WITH ") + """, e AS (SELECT c.batch, a, b, avg(CASE WHEN x.m = y.m THEN 1.0 ELSE 0.0 END) AS j
  FROM c JOIN sg x ON x.doc = a JOIN sg y ON y.doc = b AND y.i = x.i GROUP BY ALL)
SELECT batch, a, b, round(j, 6) AS estimate, round(1 - pow(1 - pow(j, 4), 32), 6) AS probability FROM e"""

Q["c11_lexical_overlap"] = lambda s, d: (
    similarity.lexical_overlap(_near(s, d), code.sequence_ratio).select("a", "b", "lexical")
)


def _near(s, d):
    """The pairs that share a band, with both texts. Documents of equal signature meet their smallest one only."""
    t = base.docs(s, d)
    p = similarity.lsh_candidates(_signatures(s, d)).select("a", "b")
    return p.join(t.select(C("doc").alias("a"), C("text").alias("text_a")), "a").join(t.select(C("doc").alias("b"), C("text").alias("text_b")), "b")


Q["c11_word_jaccard"] = lambda s, d: _near(s, d).select("a", "b", F.round(similarity.jaccard(similarity.lexical_words(C("text_a")), similarity.lexical_words(C("text_b"))), 6).alias("jaccard"))

SQL["c11_word_jaccard"] = "WITH c AS (" + SQL["c9_lsh_pairs"] + r"""),
lw AS (SELECT doc_id AS doc, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))) AS w FROM documents)
SELECT a, b, round(CASE WHEN len(x.w) > 0 AND len(y.w) > 0 THEN len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) ELSE 0.0 END, 6) AS jaccard FROM c JOIN lw x ON x.doc = a JOIN lw y ON y.doc = b"""


def _pair_corpora(s, d, pairs):
    """Each pair is a corpus of its own."""
    return products.fitted_to_pairs(similarity.term_counts(base.docs(s, d)), pairs.select("batch", "a", "b"), TfidfParams().max_terms)


Q["c12_pair_fitted_tfidf"] = lambda s, d: _pair_corpora(s, d, base.pairs(s, d)).select("a", "b", F.round("tfidf", 5).alias("tfidf"))
SQL["c12_pair_fitted_tfidf"] = (
    base.with_(base.DOCS.replace("docs AS", "docs0 AS", 1), base.SENT.replace("FROM docs", "FROM docs0"), base.PAIRS[1].replace("JOIN docs ", "JOIN docs0 "),
    "own AS (SELECT a || '-' || b AS batch, unnest([a, b]) AS doc FROM pairs)", "docs AS (SELECT own.batch, own.doc, text FROM own JOIN docs0 ON docs0.doc = own.doc)", TOKENS, TFIDF)
    + "SELECT a, b, round(tfidf, 5) AS tfidf FROM sims"
)
# the same over the pairs that share a signature band
SQL["c12_candidates_tfidf"] = (
    "WITH c AS (" + SQL["c9_lsh_pairs"] + "),\n" + base.with_(base.DOCS.replace("docs AS", "docs0 AS", 1), "own AS (SELECT a || '-' || b AS batch, unnest([a, b]) AS doc FROM c)",
    "docs AS (SELECT own.batch, own.doc, text FROM own JOIN docs0 ON docs0.doc = own.doc)", TOKENS, TFIDF).removeprefix("WITH ") + "SELECT a, b, round(tfidf, 5) AS tfidf FROM sims"
)
Q["c12_candidates_tfidf"] = lambda s, d: _pair_corpora(s, d, similarity.lsh_candidates(_signatures(s, d))).select("a", "b", F.round("tfidf", 5).alias("tfidf"))

Q["c13_matched_sentences"] = lambda s, d: similarity.class_pairs(*base.classes(s, d)).select("batch", "a", "b", "n_sentences", "n_chars").withColumn("n_chars", C("n_chars").cast("long"))
SQL["c13_matched_sentences"] = base.with_(base.DOCS, SENT) + r""", r AS (SELECT DISTINCT batch, doc, regexp_replace(lower(x), '\s+', ' ', 'g') AS x FROM (SELECT batch, doc, unnest(s) AS x FROM sent))
SELECT p.batch, p.doc AS a, q.doc AS b, count(*) AS n_sentences, CAST(sum(length(p.x)) AS BIGINT) AS n_chars FROM r p JOIN r q ON p.batch = q.batch AND p.x = q.x AND p.doc < q.doc WHERE length(p.x) >= 20 GROUP BY ALL"""

# the same as classes of documents and links between them
Q["c13_classes"] = lambda s, d: similarity.sentence_classes(base.docs(s, d))[0].withColumn("size", C("size").cast("long"))
SQL["c13_classes"] = base.with_(base.DOCS, SENT) + r""", r AS (SELECT DISTINCT batch, doc, regexp_replace(lower(x), '\s+', ' ', 'g') AS x FROM (SELECT batch, doc, unnest(s) AS x FROM sent)),
c AS (SELECT batch, x FROM r WHERE length(x) >= 20 GROUP BY ALL HAVING count(*) > 1), k AS (SELECT r.batch, doc, list(r.x ORDER BY r.x) AS k FROM r JOIN c ON c.batch = r.batch AND c.x = r.x GROUP BY ALL)
SELECT batch, doc, min(doc) OVER w AS class, count(*) OVER w AS size FROM k WINDOW w AS (PARTITION BY batch, k)"""


# exactly the pairs of at least 0.3
def _threshold(s, d):
    vectors, scales = _tight(s, d)
    return similarity.threshold_pairs(vectors, 0.3, scales)


Q["c2_threshold_pairs"] = lambda s, d: _threshold(s, d).withColumn("tfidf", F.round("tfidf", 5))
SQL["c2_threshold_pairs"] = _T + "SELECT batch, a, b, round(tfidf, 5) AS tfidf FROM sims WHERE tfidf >= 0.3"
Q["c9_containment"] = lambda s, d: similarity.containment_pairs(base.docs(s, d)).withColumn("contained", F.round("contained", 5))
SQL["c9_containment"] = base.with_(base.DOCS) + r""", w AS (SELECT batch, doc, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM docs),
g AS (SELECT DISTINCT batch, doc, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT batch, doc, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT x.batch, x.doc AS a, y.doc AS b, count(*) AS k FROM g x JOIN g y ON x.batch = y.batch AND x.g = y.g AND x.doc < y.doc GROUP BY ALL)
SELECT p.batch, a, b, round(k / least(x.n, y.n), 5) AS contained FROM p JOIN n x ON x.batch = p.batch AND x.doc = a JOIN n y ON y.batch = p.batch AND y.doc = b WHERE k >= 0.8 * least(x.n, y.n)"""


def _evidence(s, d):
    return similarity.sentence_evidence(base.docs(s, d))


EVIDENCE = r"""fp AS (SELECT batch, doc, regexp_replace(lower(x), '\s+', ' ', 'g') AS x, min(i) AS i FROM (SELECT batch, doc, unnest(s) AS x, unnest(range(0, len(s))) AS i FROM sent) GROUP BY ALL),
ev AS (SELECT p.batch, p.doc AS a, q.doc AS b, p.i AS at_a, q.i AS at_b, p.x AS sentence FROM fp p JOIN fp q ON p.batch = q.batch AND p.x = q.x AND p.doc < q.doc WHERE length(p.x) >= 20)"""
Q["c13_evidence"] = lambda s, d: _evidence(s, d).select("batch", "a", "b", C("at_a").cast("long").alias("at_a"), C("at_b").cast("long").alias("at_b"), C("s").alias("h"))
SQL["c13_evidence"] = base.with_(base.DOCS, SENT, EVIDENCE) + "SELECT batch, a, b, at_a, at_b, md5(sentence) AS h FROM ev"
Q["c13_covered"] = lambda s, d: similarity.covered_shares(similarity.class_pairs(*base.classes(s, d))).withColumns({c: F.round(c, 6) for c in ("share_a", "share_b")})
SQL["c13_covered"] = base.with_(base.DOCS, SENT, EVIDENCE) + """, e AS (SELECT batch, a, b, count(*) AS n_sentences, CAST(sum(length(sentence)) AS DOUBLE) AS n FROM ev GROUP BY ALL)
SELECT e.batch, a, b, n_sentences, round(least(1.0::DOUBLE, n / length(x.text)), 6) AS share_a, round(least(1.0::DOUBLE, n / length(y.text)), 6) AS share_b FROM e JOIN docs x ON x.doc = a JOIN docs y ON y.doc = b"""

Q["c14_matched_sources"] = lambda s, d: similarity.matched_sources(base.pairs(s, d))
SQL["c14_matched_sources"] = base.with_(base.DOCS, base.PAIRS) + """, two AS (SELECT batch, a AS doc, b AS peer, fused, copy_direction AS direction FROM pairs UNION ALL
  SELECT batch, b, a, fused, CASE copy_direction WHEN 'a_to_b' THEN 'b_to_a' WHEN 'b_to_a' THEN 'a_to_b' ELSE copy_direction END FROM pairs)
SELECT batch, doc, CAST(row_number() OVER (PARTITION BY batch, doc ORDER BY fused DESC, peer) AS INTEGER) AS rank, peer, CAST(round(fused * 100) AS BIGINT) AS percent, direction FROM two
QUALIFY row_number() OVER (PARTITION BY batch, doc ORDER BY fused DESC, peer) <= 4"""


# code blocks: templates with names, numbers and a string taken from the document
_BLOCKS = [
    "def total(xs):\n    s = 0\n    for x in xs:\n        s += x * {k}\n    return s",
    "#include <stdio.h>\nint main() {\n    printf(\"%d\", {k});\n    return 0;\n}",
    "public class Box {\n    private int size{k};\n    public int get() { return size{k}; }\n}",
]


def _literal():
    """A string of 40 characters at most, from the hash and the first letters of the whole text."""
    return F.concat(F.substring(F.md5("text"), 1, 8), F.lit(" "), F.substring(F.regexp_replace("text", "[^A-Za-z]+", " "), 1, 30))


_LITERAL = "substr(md5(text), 1, 8) || ' ' || substr(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), 1, 30)"


def blocks(s, d):
    """Every document has a block after one of three templates with a name from its text and a string that tells its text from others, and the same with one line more."""
    word = F.regexp_extract("text", "([A-Za-z]{3,})", 1)
    template = F.element_at(F.array(*map(F.lit, _BLOCKS)), (C("doc") % 3 + 1).cast("int"))
    block = F.replace(F.replace(template, F.lit("{k}"), (C("doc") % 5).cast("string")), F.lit("total"), F.concat(F.lit("f_"), word))
    block = F.concat(block, F.lit('\nnote = "'), _literal(), F.lit('"'))
    return base.docs(s, d).select("batch", "doc", "text", F.array(block, F.concat(block, F.lit("\nx = 1"))).alias("blocks"))


Q["d1_language"] = lambda s, d: blocks(s, d).select("doc", code.language(F.concat_ws("\n", F.element_at("blocks", 1), "text")).alias("language"))
_BLOCK_SQL = ", b AS (SELECT doc, replace(replace([" + ", ".join("'" + b.replace("'", "''") + "'" for b in _BLOCKS) + r"][doc % 3 + 1], '{k}', CAST(doc % 5 AS VARCHAR)), 'total', 'f_' || regexp_extract(text, '([A-Za-z]{3,})', 1)) || chr(10) || 'note = \"' || " + _LITERAL + " || '\"' || chr(10) || text AS t FROM docs)"
SQL["d1_language"] = _D + _BLOCK_SQL + ", m AS (SELECT doc, [" + ", ".join(f"{{'n': len(regexp_extract_all(t, '{p}')), 'o': {-i}, 'name': '{n}'}}" for i, (n, p) in enumerate(code.LANGUAGE_MARKS.items())) + "] AS m FROM b) SELECT doc, list_max(m).name AS language FROM m"
Q["d2_renamed_tokens"] = lambda s, d: blocks(s, d).select("doc", F.array_join(code.renamed_tokens(F.element_at("blocks", 1)), " ").alias("tokens"))
SQL["d2_renamed_tokens"] = _D + f"""SELECT doc, CASE doc % 3 WHEN 0 THEN 'def var0 ( var1 ) : var2 = 0 for var3 in var1 : var2 + = var3 * ' || (doc % 5) || ' return var2 var4'
  WHEN 1 THEN '# include < var0 . var1 > int main ( ) {{ printf ( "%d" , ' || (doc % 5) || ' ) ; return 0 ; }} var2'
  ELSE 'public class var0 {{ private int var1 ; public int var2 ( ) {{ return var1 ; }} }} var3' END || ' = "' || {_LITERAL} || '"' AS tokens FROM docs"""


def _code_blocks(s, d):
    return code.block_rows(blocks(s, d))


Q["d3_d5_code_score"] = lambda s, d: code.candidate_scores(_code_blocks(s, d)).withColumn("code_score", F.round("code_score", 6))
# pairs that share sentences: those with equal code after renaming, and how many ratios the bounds spared
Q["d5_has_both"] = lambda s, d: code.shared_scores(base.docs(s, d), _code_blocks(s, d)).select("batch", "n_scored", "n_equal", "n")
SQL["d5_has_both"] = base.with_(base.DOCS, base.PAIRS) + f""", l AS (SELECT doc, {_LITERAL} AS l FROM docs)
SELECT batch, count(*) AS n_scored, count(*) FILTER (WHERE a % 3 = b % 3 AND (a % 3 = 2 OR a % 5 = b % 5) AND x.l = y.l) AS n_equal, count(*) AS n FROM pairs JOIN l x ON x.doc = a JOIN l y ON y.doc = b GROUP BY 1"""
Q["d4_bounds"] = lambda s, d: code.shared_scores(base.docs(s, d), _code_blocks(s, d)).where("n_both > 0").select("batch", C("n_both").alias("n"), "n_ratios", (C("n_tried") <= C("n_ratios")).alias("spared"))
SQL["d4_bounds"] = base.with_(base.DOCS, base.PAIRS) + "SELECT batch, count(*) AS n, CAST(4 * count(*) AS BIGINT) AS n_ratios, true AS spared FROM pairs GROUP BY 1"


def raw_submissions(s, d):
    """Every document; before the text of every third stands a fenced block, as the texts hold no code."""
    fence = F.concat(F.lit("```\n"), F.element_at("blocks", 1), F.lit("\n```\n"))
    return blocks(s, d).select("batch", "doc", F.when(C("doc") % 3 == 0, F.concat(fence, "text")).otherwise(C("text")).alias("text"))


# from raw texts to risks by every stage; tested on a small fixture
Q["process_batches"] = lambda s, d: (
    processing.process(raw_submissions(s, d), f"{shared_dir(s)}/batches-{uuid.uuid4().hex}")["risks"]
    .select("batch", "doc", "has_code", *(F.round(c, 5).alias(c) for c in ("text_sim_max", "code_sim_max", "ai_prob", "weighted_score")), "risk_level", "weight_profile")
)
Q["d6_code_candidates"] = lambda s, d: similarity.lsh_counts(similarity.minhash_signatures(code.token_grams(_code_blocks(s, d)), k=1))
