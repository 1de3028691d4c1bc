"""op9: the verdict on every page's url."""

from gridlore.llm.common import table
from gridlore.llm.urlfilter import judge_urls, rules_frame

NAME = "op9_filter_urls"
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(spark, sf_dir):
    judged = judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES), url_col="url", carry=("page_id",))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, url, row_number() OVER () AS rid,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, rid,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT p.rid, r.rhost || r.rpath AS rule, r.rverdict,
         row_number() OVER (PARTITION BY p.rid ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM parts p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.rid = p.rid AND f.k = 1
"""
