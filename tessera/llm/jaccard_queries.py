"""op6: near-duplicate components of documents."""

from tessera.llm.jaccard import JaccardJoin

NAME = "op6_ngram_jaccard"


def query(spark, sf_dir):
    """Shingle counts and components of all documents."""
    return JaccardJoin().components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
post AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM post a JOIN post b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 75 * (x.n + y.n - i)),
links AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sizes UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.r < links.b)
SELECT s.doc_id, s.n AS n_shingles, min(r) AS component_id FROM sizes s JOIN reach ON reach.doc_id = s.doc_id GROUP BY 1, 2
"""
