"""op12: how far the sources of each language are apart, and the terms that set each one off."""

from tessera.llm.divergence import audit

NAME = "op12_source_divergence"


def query(spark, sf_dir):
    """The audit of every group over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT i, lang, source, unnest(w) AS term FROM d),
grp AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
lt AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY 1),
cnt AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept k USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * lt.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (lt.total + 2 * lt.v) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN lt ON lt.lang = g.lang
  LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
