"""Query of the license scan."""

from pyspark.sql import DataFrame, SparkSession

from geotrends.llm.licenses import scan_licenses
from geotrends.llm.registry import query, table


@query("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and templates in every whole text."""
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return scanned.select("doc_id", *[f"license.{c}" for c in fields])
