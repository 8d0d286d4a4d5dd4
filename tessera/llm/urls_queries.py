"""op1: a verdict for every page."""

from tessera.llm.urls import judge

NAME = "op1_redirect_equivalence"
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def query(spark, sf_dir):
    """Host, path, rule and verdict of all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")


_PARTS = """translate(regexp_extract(coalesce({u}, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(coalesce({u}, ''), '^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1, 's') AS query"""
_VALUE = """\\s*=\\s*(?:"([^"]*)"?|''([^'']*)''?|([^\\s"''>]+))"""
_OF = lambda name: " || ".join(f"""regexp_extract(tag, '[\\s"''/]{name}{_VALUE}', {g}, 'is')""" for g in (1, 2, 3))

#: Of the links in the html, only those to absolute addresses: the tables have none of any kind, and a test has the rest.
SQL = f"""
WITH RECURSIVE rules(rule, h, p, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
pg AS (SELECT page_id, url, html, {_PARTS.format(u="url")} FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '<(?:link|meta)\\b[^>]*', 0, 'is')) AS tag FROM pg WHERE host <> ''),
link AS (
  SELECT url, CASE
    WHEN lower(tag) LIKE '<link%' AND regexp_matches(tag, '[\\s"''/]rel\\s*=\\s*(?:"[^"]*\\bcanonical\\b|''[^'']*\\bcanonical\\b|canonical\\b)', 'is') THEN {_OF("href")}
    WHEN lower(tag) LIKE '<meta%' AND regexp_matches(tag, '[\\s"''/]http-equiv\\s*=\\s*["'']?\\s*refresh\\b', 'is') THEN regexp_extract({_OF("content")}, '\\burl\\s*=\\s*["'']?\\s*([^"''\\s]+)', 1, 'is') END AS target
  FROM tags),
absolute AS (SELECT url, target FROM link WHERE regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://')),
place AS (SELECT url, host, path, host || regexp_replace(path, '/+$', '') || query AS addr FROM (
  SELECT url, host, path, query FROM pg WHERE host <> '' UNION SELECT target, {_PARTS.format(u="target")} FROM absolute)),
judged AS (
  SELECT a.url, any_value(a.addr) AS addr, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM place a LEFT JOIN rules r ON (a.host = r.h OR ends_with(a.host, '.' || r.h)) AND starts_with(a.path, r.p) GROUP BY a.url),
edge AS (SELECT x.addr AS a, y.addr AS b FROM absolute l JOIN place x ON x.url = l.url JOIN place y ON y.url = l.target),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(n, r) AS (SELECT addr, addr FROM judged UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.n WHERE reach.r < e.b),
comp AS (SELECT n, min(r) AS c FROM reach GROUP BY 1),
flag AS (SELECT c, bool_or(verdict = 'allow') AS any_allow, bool_or(verdict = 'block') AS any_block FROM judged JOIN comp ON comp.n = judged.addr WHERE verdict IS NOT NULL GROUP BY 1)
SELECT p.page_id, p.host, p.path, j.rule,
  coalesce(j.verdict, CASE WHEN f.any_block AND NOT f.any_allow THEN 'block' ELSE 'allow' END) AS verdict
FROM pg p LEFT JOIN judged j ON j.url = p.url AND p.host <> '' LEFT JOIN comp ON comp.n = j.addr LEFT JOIN flag f ON f.c = comp.c
"""
