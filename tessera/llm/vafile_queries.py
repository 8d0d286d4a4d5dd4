"""op5: the five best rows for every fiftieth vector."""

from pyspark.sql import functions as F

from tessera.llm.vafile import quantised, top_k

NAME = "op5_va_file_top_k"


def query(spark, sf_dir):
    """The five best of every 50th vector among all others."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where(F.pmod("vec_id", F.lit(50)) == 0), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
