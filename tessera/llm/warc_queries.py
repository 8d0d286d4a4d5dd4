"""op11: every page as a WARC record in seekable bundles, read back."""

import uuid

from tessera.llm.scratch import shared_dir
from tessera.llm.warc import read_digests, write_bundles

NAME = "op11_warc_bundles"


def query(spark, sf_dir):
    """Writes the archives of all pages below the shared folder, then measures what they hold."""
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_digests(spark, folder, index)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, strlen(html) AS n, CASE WHEN strlen(html) >= 100 AND count(*) OVER w > 1 THEN min(page_id) OVER w END AS first FROM p WINDOW w AS (PARTITION BY html))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
