"""Full refresh: documents to tables, with profiles."""

from collections import Counter

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrends.operators.quality import duplicate_count, profile_info
from geotrends.schemas import SCHEMAS
from geotrends.sinks.tables import create_tables, refresh, write_csv
from geotrends.sources.extractors import EXTRACTORS, extract
from geotrends.sources.json_tree import read_country_tree, read_tree


def extract_tables(
    spark: SparkSession, root: str, strict: bool = True, kept: list[DataFrame] | None = None
) -> dict[str, DataFrame]:
    """All 14 flat tables of the document tree under ``root``, lazily.

    With ``kept``, documents that feed two tables are persisted on disk and
    added to it; the caller releases them.
    """
    trees = {}
    uses = Counter((x.entity, x.country) for x in EXTRACTORS.values())
    for entity, country in uses:
        reader = read_country_tree if country else read_tree
        trees[entity, country] = reader(spark, root, entity, strict=strict)
        if kept is not None and uses[entity, country] > 1:
            kept.append(trees[entity, country].persist(StorageLevel.DISK_ONLY))
    return {table: extract(trees[x.entity, x.country], table) for table, x in EXTRACTORS.items()}


def refresh_from_tree(
    spark: SparkSession,
    root: str,
    db: str,
    location: str | None = None,
    csv_root: str | None = None,
    strict: bool = True,
) -> None:
    """Replace all tables of ``db`` by the content of the tree.

    The documents are read once, into the tables; CSV copies are written from
    the tables.
    """
    create_tables(spark, db, location)
    kept: list[DataFrame] = []
    try:
        refresh(spark, db, extract_tables(spark, root, strict, kept))
    finally:
        for documents in kept:
            documents.unpersist()
    if csv_root:
        for table, schema in SCHEMAS.items():
            write_csv(spark.table(f"{db}.{table}").select(*schema.names), f"{csv_root}/{table}")


def profile_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``info`` (columns, types, filled and empty cells) and ``duplicates`` of all tables."""
    infos, duplicates = [], []
    for name, df in tables.items():
        info = profile_info(df).withColumn("nulls", F.col("rows") - F.col("non_null"))
        infos.append(info.select(F.lit(name).alias("table"), "*"))
        duplicates.append(duplicate_count(df).select(F.lit(name).alias("table"), "*"))
    return {"info": _union(infos), "duplicates": _union(duplicates)}


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df)
    return result
