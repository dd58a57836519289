"""Joins of aggregated frames.

Both sides are aggregated first, so what meets in the join has one row per
key. There are no broadcast hints: the size of each side is known at run time
and adaptive execution broadcasts it only when it is small enough, else the
sides stay hash partitioned on the join key they were already grouped by.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import SEGMENT_GROWTH, SEGMENT_VOLUME
from geotrends.functions.numbers import safe_ratio, segment


def app_open_rate(agg_user: DataFrame, map_user: DataFrame) -> DataFrame:
    """App opens of a state and year per user of each brand there."""
    brands = agg_user.groupBy("state", "year", "brand").agg(F.sum("user_count").alias("brand_users"))
    usage = map_user.groupBy("state", "year").agg(
        F.sum("registered_users").alias("users"), F.sum("appopen_count").alias("counts")
    )
    return brands.join(usage, ["state", "year"]).withColumn(
        "app_open_rate", safe_ratio(F.col("counts"), F.col("brand_users"))
    )


def users_with_location(top_user_district: DataFrame, location: DataFrame) -> DataFrame:
    """Users per district with one coordinate pair of the district.

    A place repeats once per quarter in the location table; one repeat is kept,
    the smallest pair, before the join.
    """
    place = ["state", "district"]
    users = top_user_district.groupBy(*place).agg(F.sum("registered_users").alias("users"))
    spots = location.groupBy(*place).agg(F.min(F.struct("longitude", "latitude")).alias("spot"))
    return users.join(spots, place).select(*place, "users", "spot.longitude", "spot.latitude")


def state_priority(
    growth: DataFrame,
    map_insurance: DataFrame,
    min_growth: float = SEGMENT_GROWTH,
    min_volume: float = SEGMENT_VOLUME,
) -> DataFrame:
    """Growth and total volume per state, with the segment."""
    volume = map_insurance.groupBy("state").agg(F.sum("insurance_count").alias("total_volume"))
    return growth.join(volume, "state").select(
        "state",
        "growth_percent",
        "total_volume",
        segment(F.col("growth_percent"), F.col("total_volume"), min_growth, min_volume).alias("state_category"),
    )


def join_boundaries(df: DataFrame, boundaries: DataFrame, on: str = "state") -> DataFrame:
    """Rows with the geometry of their place."""
    return df.join(boundaries.withColumnRenamed("name", on), on)


def unmatched_names(df: DataFrame, boundaries: DataFrame, on: str = "state") -> DataFrame:
    """Names that :func:`join_boundaries` cannot match: ``name, side``."""

    def missing(names: DataFrame, others: DataFrame, side: str) -> DataFrame:
        return names.join(others, "name", "left_anti").select("name", F.lit(side).alias("side"))

    data = df.select(F.col(on).alias("name")).distinct()
    shapes = boundaries.select("name").distinct()
    return missing(data, shapes, "data").unionByName(missing(shapes, data, "boundary"))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, condition, how).drop(*[f"_{k}" for k in keys])
