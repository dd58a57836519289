"""Filters: scope, place, first or last period, flags."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import ALL, UNDERUTILIZED_MAX_RATE, UNDERUTILIZED_MIN_USERS
from geotrends.session import computed_once


def filter_scope(df: DataFrame, state: str = ALL, year: int | str = ALL, quarter: str = ALL) -> DataFrame:
    """Rows of one state, year and quarter; ``"All"`` leaves a key open.

    Plain equality with literals, so the filters reach the scan and prune
    partitions.
    """
    for name, wanted in (("state", state), ("year", year), ("quarter", quarter)):
        if wanted != ALL:
            df = df.filter(F.col(name) == F.lit(int(wanted) if name == "year" else wanted))
    return df


def filter_place(df: DataFrame, state: str = ALL, district: str = ALL) -> DataFrame:
    """Rows of one state and one district of it."""
    if state != ALL:
        df = df.filter(F.col("state") == state)
    if district != ALL:
        df = df.filter(F.col("district") == district)
    return df


def latest_rows(df: DataFrame, by: str = "year", how: str = "max") -> DataFrame:
    """Rows of the last (``max``) or first (``min``) value of ``by``.

    The bound is a scalar subquery: one row, computed once, no join.
    """
    df = computed_once(df)
    pick = {"max": F.max, "min": F.min}[how]
    return df.filter(F.col(by) == df.agg(pick(by)).scalar())


def flag_underutilized(
    df: DataFrame,
    min_users: float = UNDERUTILIZED_MIN_USERS,
    max_rate: float = UNDERUTILIZED_MAX_RATE,
    keep_all: bool = False,
) -> DataFrame:
    """Rows with many users and few app opens; an unknown rate is not flagged.

    ``keep_all`` returns every row with the flag.
    """
    flag = (F.col("brand_users") > min_users) & (F.col("app_open_rate") < max_rate)
    flagged = df.withColumn("underutilized", F.coalesce(flag, F.lit(False)))
    return flagged if keep_all else flagged.filter("underutilized")
