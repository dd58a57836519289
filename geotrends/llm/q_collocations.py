"""Query of phrase collocation mining."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.collocations import collocations
from geotrends.llm.registry import query, table

SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i : i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) sizes WHERE len(words) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND a >= 30),
k AS (
  SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS left_part, array_to_string(words[k + 1 : m], ' ') AS right_part
  FROM c, (SELECT unnest([1, 2, 3]) AS k) cuts WHERE k < m),
s AS (
  SELECT k.*, x.a AS l, y.a AS r, CAST(2000000 AS HUGEINT) * k.a // (x.a + y.a) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = left_part JOIN f y ON y.lang = k.lang AND y.phrase = right_part),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT DISTINCT x.lang, x.phrase FROM b x JOIN c y ON y.lang = x.lang AND 100 * y.a >= 80 * x.a
  WHERE y.m > len(string_split(x.phrase, ' ')) AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT b.*, CAST(t.n AS BIGINT) AS n,
    row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b JOIN t ON t.lang = b.lang ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase)
WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))
