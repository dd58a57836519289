"""The training-data pipeline: from documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept;
all but the last return the columns of ``documents``. An empty ``docs`` gives an
empty result. Columns beyond those of ``documents`` pass through the stages,
whatever their names; every row is judged by its own text, also where ids repeat
or are null.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrends.llm.decontaminate import overlapping_rows
from geotrends.llm.near_dups import near_duplicates, without_ids
from geotrends.llm.q_packing import packed
from geotrends.llm.q_quality import THRESHOLD, quality_scores
from geotrends.llm.registry import table
from geotrends.llm.repeats import remove_repeats
from geotrends.llm.shared_store import written
from geotrends.session import materialize


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _any_columns(stage: Stage) -> Stage:
    """Give further columns names that meet none of the stage's own while it runs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in _DOCUMENTS else f"further_column_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run_stage


@_any_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are judged by its bias."""
    scored = quality_scores(spark, docs, sf_dir)
    return scored.where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


@_any_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near-duplicates: that of the smallest id, a null id last.

    Rows are told apart by a number of their own, so repeated rows and copies
    with a null id are members like any other, and a row that reuses the id
    of another text belongs to the group of its own text. Of rows with equal ids in
    a group the one with the smallest hash of its text stays. Texts without words all stay.
    """
    row = "_row"
    # Stored once: the numbers must be the same wherever they are read.
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-dedup-rows")
    near = near_duplicates(rows, row).where("n_shingles > 0").select(F.col(row).alias("key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(row).alias("key"))
    near = materialize(near.join(rows.select(F.col(row).alias("key"), order.alias("place")), "key"))
    stays = near.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.key").alias("key"))
    dropped = near.select("key").join(stays, "key", "left_anti")
    return without_ids(rows, row, materialize(dropped)).select(*[F.col(f"`{c}`") for c in docs.columns])


@_any_columns
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; a text that loses nothing stays as it is.

    Every occurrence of a repeated passage goes. A document may be left with
    an empty text; ``n_chars`` is that of the new text.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeats(docs, carry=carried, as_is=True)
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("carried.n_chars"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": size}
    return out.select(*[columns.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


@_any_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; one of fewer than five words must be the whole document."""
    row = "_row"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    gone = materialize(overlapping_rows(rows, row, table(spark, sf_dir, "benchmark")))
    return without_ids(rows, row, gone).select(*docs.columns)



def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Neither the classifier nor the tokens can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
