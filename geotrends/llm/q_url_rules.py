"""Query of the URL filters."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.registry import query, table
from geotrends.llm.url_rules import judge_urls

# Fixed rules of this query: host, path prefix, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

SQL = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(map(str, RULES))}),
rest AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest),
parts AS (
  SELECT n, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (
  SELECT n, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM parts, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""


@query("op8_url_rules", SQL)
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
