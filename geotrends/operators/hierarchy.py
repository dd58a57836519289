"""Totals along a path of keys, with shares of parent and root."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrends.fixed_values import SEGMENT_ROOT
from geotrends.functions.numbers import money_sum
from geotrends.operators.aggregates import exact_sum
from geotrends.operators.joins import join_keys
from geotrends.session import materialize


def _nodes(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """(level, path, value, _square) of every node.

    The rows are summed at the full path. All levels above are summed from the
    one next to it, which the rollup multiplies instead of the leaves.
    """
    # Squares of whole numbers are summed as such; those of doubles from their exact sum.
    whole = not isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))
    number = F.col(value).cast("decimal(19,0)" if whole else "double")
    square = F.sum((number * number).cast("decimal(38,0)")) if whole else money_sum(number * number)

    def sums(of: DataFrame) -> list[Column]:
        return [exact_sum(of, "value").alias("value"), (F.sum("_square") if whole else money_sum(F.col("_square"))).alias("_square")]

    leaves = df.groupBy(*path).agg(exact_sum(df, value).alias("value"), square.alias("_square"))
    above = leaves.groupBy(*path[:-1]).agg(*sums(leaves)) if len(path) > 1 else leaves
    # grouping_id has one trailing 1-bit per rolled-up column.
    level = (F.lit(max(1, len(path) - 1)) - F.bit_count(F.grouping_id(*(path[:-1] or path)))).cast("int")
    upper = above.rollup(*(path[:-1] or path)).agg(level.alias("level"), *sums(above))
    if len(path) == 1:
        return upper.select("level", *path, "value", "_square")
    last = F.lit(None).cast(df.schema[path[-1]].dataType).alias(path[-1])
    return leaves.select(F.lit(len(path)).alias("level"), *path, "value", "_square").unionAll(
        upper.select("level", *path[:-1], last, "value", "_square")
    )


def hierarchy_rollup(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """One row per prefix of ``path``, the root included.

    Columns: ``level`` (0 is the root), the path columns (null below the
    level), ``value``, ``weighted`` (mean of the value weighted by itself),
    ``pct_parent`` and ``pct_root``. The rows are read once, and all nodes are kept
    once for the shares. Parents are found by a join: a parent with very
    many children is not gathered in one place.
    """
    path = list(path)
    nodes = materialize(_nodes(df, path, value))
    weighted = F.col("_square").cast("double") / F.nullif(F.col("value").cast("double"), F.lit(0.0))
    parents = nodes.filter(F.col("level") < len(path)).select(
        (F.col("level") + 1).alias("_child_level"),
        *[F.col(c).alias(f"_up_{c}") for c in path[:-1]],
        F.col("value").alias("_parent_value"),
    )
    child = nodes.withColumn("weighted", weighted).withColumn("_child_level", F.col("level"))
    for depth, c in enumerate(path[:-1], start=1):
        child = child.withColumn(f"_up_{c}", F.when(F.col("level") > depth, F.col(c)))
    joined = join_keys(child, parents, ["_child_level", *[f"_up_{c}" for c in path[:-1]]], "left")
    total = nodes.where("level = 0").agg(F.first("value").cast("double")).scalar()
    # The root is its own parent.
    parent_value = F.when(F.col("level") == 0, F.col("value")).otherwise(F.col("_parent_value")).cast("double")
    return joined.select(
        "level",
        *path,
        "value",
        "weighted",
        (F.col("value") / F.nullif(parent_value, F.lit(0.0))).alias("pct_parent"),
        (F.col("value") / F.nullif(total, F.lit(0.0))).alias("pct_root"),
    )


def category_tree(df: DataFrame, category: str = "state_category", item: str = "state") -> DataFrame:
    """Constant root, category and item with the number of rows below each."""
    level = (F.lit(2) - F.bit_count(F.grouping_id(category, item))).cast("int")
    return df.rollup(category, item).agg(level.alias("level"), F.count(F.lit(1)).alias("members")).select(
        F.lit(SEGMENT_ROOT).alias("root"), "level", category, item, "members"
    )
