"""op2: near-duplicate vectors of each label."""

from tessera.llm.pq import near_duplicates

NAME = "op2_product_quantisation"


def query(spark, sf_dir):
    """Links and components of all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM v UNION
  SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.vec_id WHERE reach.r < link.b),
comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n ON n.a = v.vec_id
"""
