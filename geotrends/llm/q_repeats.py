"""Query of substring dedup."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrends.llm.registry import query, table
from geotrends.llm.repeats import remove_repeats

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT n, i, array_to_string(words[i : i + 34], ' ') AS win
  FROM (SELECT n, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
r AS (SELECT n, i FROM w WHERE md5(win) IN (SELECT md5(win) FROM w GROUP BY 1 HAVING count(*) > 1)),
gone AS (SELECT n, list(DISTINCT p) AS ps FROM (SELECT n, unnest(range(i, i + 35)) AS p FROM r) GROUP BY n),
k AS (
  SELECT d.n, doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN array_to_string(words, ' ') END AS whole, words, ps
  FROM d LEFT JOIN gone USING (n)),
s AS (
  SELECT n, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM k WHERE ps IS NOT NULL) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT n AS m, unnest(ps) AS q FROM k WHERE ps IS NOT NULL) g WHERE g.m = u.n AND g.q = u.p)
  GROUP BY n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(whole, kept, '')) AS kept_sha256
FROM k LEFT JOIN s USING (n)
"""


@query("op10_repeats", SQL)
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
