"""Query of benchmark decontamination."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.decontaminate import benchmark_overlaps
from geotrends.llm.registry import query, table


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
