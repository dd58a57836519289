"""Query of centroid clustering."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.lloyd import Settings, clusters
from geotrends.llm.registry import query, table


def _sql(s: Settings = Settings()) -> str:
    """Each round as a step of its own: distances, nearest centroid, floored means."""

    def nearest(of: int) -> str:
        return f"""a{of} AS MATERIALIZED (
  SELECT row, vec_id, v, arg_min(k, struct_pack(dist := dist, k := k)) AS k, min(dist) AS dist FROM (
    SELECT row, vec_id, v, k, list_sum(list_transform(range(1, {s.columns + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS dist
    FROM v, c{of}) GROUP BY row, vec_id, v)"""

    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {s.columns} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {s.columns})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (
    SELECT sha256('{s.seed}:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {s.clusters}))""",
        nearest(0),
    ]
    for r in range(1, s.rounds + 1):
        steps.append(f"""m{r} AS (
  SELECT k, list(m ORDER BY i) AS c FROM (
    SELECT k, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM (SELECT k, unnest(range(1, {s.columns + 1})) AS i, unnest(v) AS x FROM a{r - 1}) GROUP BY k, i) GROUP BY k),
c{r} AS MATERIALIZED (SELECT k, coalesce(m.c, p.c) AS c FROM c{r - 1} p LEFT JOIN m{r} m USING (k))""")
        steps.append(nearest(r))
    last = s.rounds
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (k)
"""


@query("op12_lloyd", _sql())
def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    return clusters(table(spark, sf_dir, "embeddings"))
