"""Query of near-duplicate detection."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.near_dups import near_duplicates
from geotrends.llm.registry import query, table

SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (
  SELECT doc_id, CASE WHEN len(words) >= 5
    THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i : i + 4], ' '))))
    WHEN len(words) > 0 THEN [md5(array_to_string(words, ' '))] ELSE [] END AS shingles FROM d),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY list_sort(shingles)) AS first FROM x),
r AS (SELECT doc_id, shingles FROM c WHERE doc_id = first AND len(shingles) > 0),
s AS (SELECT doc_id, unnest(shingles) AS sh FROM r),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN r ra ON ra.doc_id = a JOIN r rb ON rb.doc_id = b
  WHERE 100 * n >= 75 * (len(ra.shingles) + len(rb.shingles) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, seen) AS (SELECT a, b FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
k AS (SELECT node, least(node, min(seen)) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles,
  CASE WHEN len(shingles) = 0 THEN doc_id ELSE coalesce(component, first) END AS component_id,
  doc_id = CASE WHEN len(shingles) = 0 THEN doc_id ELSE coalesce(component, first) END AS kept
FROM c LEFT JOIN k ON k.node = first
"""


@query("op9_near_dups", SQL)
def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
