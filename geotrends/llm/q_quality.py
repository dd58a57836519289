"""Query of the quality classifier."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrends.llm.quality import score, train, training_sample
from geotrends.llm.registry import query, table

THRESHOLD = 0.3


def held_out():
    """Ids that are never learned from; a null id is not held out (and has no label)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``, learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    weights = train(training_sample(docs, labels, "quality"))
    return docs.withColumn("quality_score", score("text", weights, spark))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    scored = quality_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
