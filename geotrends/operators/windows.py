"""Values taken from other rows: previous period, totals, bounds."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrends.fixed_values import MARKER_SIZES, RISING_MAX_PREVIOUS, RISING_MIN_GROWTH
from geotrends.functions.numbers import pct_change
from geotrends.functions.text import place_year_label
from geotrends.operators.aggregates import exact_sum, sum_columns
from geotrends.session import computed_once

# Keys whose number of values is bounded by the calendar: a four-digit year and
# a one-character quarter tag. Only totals per such a key are broadcast.
PERIOD_KEYS = ("year", "quarter")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "previous") -> DataFrame:
    """Value of the previous row within ``keys``; gaps in ``order`` are not filled.

    ``df`` must have one row per (keys, order), as after a sum, so that a
    window holds one row per period however many rows went into it.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.lag(value).over(window))


def rising_places(
    df: DataFrame,
    value: str = "transaction_count",
    max_prev: float = RISING_MAX_PREVIOUS,
    min_growth: float = RISING_MIN_GROWTH,
) -> DataFrame:
    """Districts that grew strongly from a small base, fastest first."""
    yearly = df.groupBy("state", "year", "district").agg(exact_sum(df, value).alias("count"))
    grown = with_previous(yearly, ["state", "district"], "year", "count", "prev_year_count").withColumn(
        "growth_percentage", pct_change(F.col("count"), F.col("prev_year_count"))
    )
    rising = grown.filter((F.col("prev_year_count") < max_prev) & (F.col("growth_percentage") > min_growth))
    labelled = rising.withColumn("state_year", place_year_label(F.col("state"), F.col("year")))
    return labelled.orderBy(F.desc("growth_percentage"), "state", "district", "year")


def with_total(df: DataFrame, measures: dict[str, str], by: str | None = None) -> DataFrame:
    """Put totals (column -> name) on every row: of the frame, or of the row's period.

    Frame totals are scalar subqueries. Period totals are one row per period
    and are broadcast, so the rows themselves are not shuffled, sorted or
    gathered by period. A computed frame is stored, so that its input is read once.
    """
    if by is not None and by not in PERIOD_KEYS:
        raise ValueError(f"totals are per {PERIOD_KEYS}, not per {by}")
    df = computed_once(df)
    if by is None:
        every = df.agg(F.struct(*sum_columns(df, measures)).alias("every")).scalar()
        return df.withColumns({name: every[name] for name in measures.values()})
    totals = df.groupBy(by).agg(*sum_columns(df, measures))
    return df.join(F.broadcast(totals), by, "left")


def with_log(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_log``: the natural logarithm of one plus the value."""
    return df.withColumn(f"{column}_log", F.log1p(column))


def rescale(df: DataFrame, column: str, name: str, lo: float = MARKER_SIZES[0], hi: float = MARKER_SIZES[1]) -> DataFrame:
    """Map the range of a column linearly to ``lo .. hi``; a single value maps to ``hi``."""
    df = computed_once(df)
    x = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    slope = F.lit(float(hi - lo)) / F.nullif(high - low, F.lit(0.0))
    return df.withColumn(
        name, F.when(x >= high, F.lit(float(hi))).when(x <= low, F.lit(float(lo))).otherwise(slope * (x - low) + lo)
    )
