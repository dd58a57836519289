"""Flat sources: tables, CSV files, boundaries and literal rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, name: str, db: str | None = None) -> DataFrame:
    """A table of the catalog."""
    return spark.table(f"{db}.{name}" if db else name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header row that names the columns of the schema in its order.

    Quotes inside a value are doubled. Another header or a row that does not
    fit the schema stops the job.
    """
    options = {"header": True, "enforceSchema": False, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options).csv(path)


def read_boundaries(spark: SparkSession, path: str, name_property: str = "ST_NM") -> DataFrame:
    """One row per feature of a GeoJSON collection: ``name, geometry_json``.

    The geometry stays text, as nothing looks inside it.
    """
    schema = f"features ARRAY<STRUCT<properties: STRUCT<{name_property}: STRING>, geometry: STRING>>"
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("features").alias("feature"))
        .select(
            F.col(f"feature.properties.{name_property}").alias("name"),
            F.col("feature.geometry").alias("geometry_json"),
        )
    )


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A frame of rows written in the code."""
    return spark.createDataFrame(list(rows), schema)
