"""Query of language-model scoring."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrends.llm.backoff import backoff_scores
from geotrends.llm.registry import query, table

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT n, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
g AS (SELECT n, i, w AS c, lag(w) OVER x AS b, lag(w, 2) OVER x AS a FROM t WINDOW x AS (PARTITION BY n ORDER BY i)),
u1 AS (SELECT c, count(*) AS n1 FROM g GROUP BY c),
u2 AS (SELECT b, c, count(*) AS n2 FROM g WHERE b IS NOT NULL GROUP BY ALL),
u3 AS (SELECT a, b, c, count(*) AS n3 FROM g WHERE a IS NOT NULL GROUP BY ALL),
s AS (
  SELECT g.n, g.i, g.b, g.a, n1, n2, n3, u1b.n1b, u2b.n2b, (SELECT count(*) FROM g) AS total
  FROM g JOIN u1 USING (c) LEFT JOIN u2 USING (b, c) LEFT JOIN u3 USING (a, b, c)
  LEFT JOIN (SELECT c AS b, n1 AS n1b FROM u1) u1b USING (b)
  LEFT JOIN (SELECT b AS a, c AS b, n2 AS n2b FROM u2) u2b USING (a, b)),
p AS (
  SELECT n, CASE WHEN i >= 3 THEN n3 < 2 WHEN i = 2 THEN n2 < 2 ELSE false END AS fell,
    CASE WHEN i >= 3 AND n3 >= 2 THEN n3 / n2b
      ELSE (CASE WHEN i >= 3 THEN 0.4 ELSE 1 END) * (CASE WHEN i >= 2 AND n2 >= 2 THEN n2 / n1b
        ELSE (CASE WHEN i >= 2 THEN 0.4 ELSE 1 END) * n1 / total END) END AS score FROM s),
q AS (SELECT n, count(*) FILTER (fell) AS n_backoff, sum(ln(score)) AS log_score FROM p GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff,
  round(coalesce(log_score, 0), 4) AS log_score
FROM d LEFT JOIN q USING (n)
"""


@query("op1_backoff", SQL)
def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the trigram counts of all documents."""
    scores = backoff_scores(table(spark, sf_dir, "documents"))
    return scores.withColumn("log_score", F.round("log_score", 4))
