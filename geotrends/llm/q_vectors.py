"""Query of embedding near-dedup."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.registry import query, table
from geotrends.llm.vectors import near_vectors


@query("op6_vectors")
def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked embeddings of one label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
