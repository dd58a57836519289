"""Users: engagement, brands, app-open rates, places."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import (
    ALL,
    BRAND_SKIPPED_YEAR,
    UNDERUTILIZED_MAX_RATE,
    UNDERUTILIZED_MIN_USERS,
    UNDERUTILIZED_ROWS,
)
from geotrends.operators.aggregates import one_per_key, regroup_sum, totals_with_gross, value_range, with_text
from geotrends.operators.joins import app_open_rate, users_with_location
from geotrends.operators.matrix import matrix_long
from geotrends.operators.ranking import head_n, top_places
from geotrends.operators.scope import flag_underutilized, latest_rows
from geotrends.operators.windows import rescale, with_log
from geotrends.plans.outputs import Outputs
from geotrends.session import materialize

_USER_TEXTS = {"user_count": "user_counts_f", "open_count": "open_counts_f"}


def _state_year_sums(map_user: DataFrame) -> DataFrame:
    return map_user.groupBy("state", "year").agg(
        F.sum("registered_users").alias("user_count"), F.sum("appopen_count").alias("open_count")
    )


def state_year_users(map_user: DataFrame) -> DataFrame:
    """Users and app opens by state and year, fewest users first."""
    texts = with_text(_state_year_sums(map_user), _USER_TEXTS, as_double=True)
    return texts.orderBy("user_count", "state", "year")


def user_engagement(map_user: DataFrame, periods: DataFrame) -> Outputs:
    """``rows``, ``totals``, ``map``, ``map_start``, ``map_range``, ``matrix``, ``matrix_range``.

    ``periods`` lists the years to total.
    """
    measures = ["user_count", "open_count"]

    def totals() -> DataFrame:
        sums = totals_with_gross(_state_year_sums(map_user), "year", measures, periods)
        return with_text(sums, _USER_TEXTS, as_double=True)

    def mapped() -> DataFrame:
        return with_log(state_year_users(map_user), "user_count")

    def cells() -> DataFrame:
        sums = regroup_sum(map_user, ["state", "year"], {"registered_users": "user_count", "appopen_count": "open_count"})
        texts = with_text(sums, _USER_TEXTS, as_double=True)
        return matrix_long(texts, "state", "year", "user_count", layers=["user_counts_f", "open_counts_f"])

    return Outputs(
        {
            "rows": lambda: state_year_users(map_user),
            "totals": totals,
            "map": mapped,
            "map_start": lambda: with_log(state_year_users(latest_rows(map_user)), "user_count"),
            "map_range": lambda: value_range(mapped(), "user_count_log"),
            "matrix": cells,
            "matrix_range": lambda: value_range(cells(), "z"),
        }
    )


def brand_totals(aggregated_user: DataFrame) -> DataFrame:
    """Users per brand, fewest first."""
    return aggregated_user.groupBy("brand").agg(F.sum("user_count").alias("user_count")).orderBy("user_count", "brand")


def brand_state_year(aggregated_user: DataFrame, skipped_year: int = BRAND_SKIPPED_YEAR) -> DataFrame:
    """Users by state, year and brand, without one year.

    A period that repeats for a brand and state counts once.
    """
    kept = aggregated_user.filter(F.col("year") != skipped_year)
    once = one_per_key(kept, ["state", "brand", "year", "quarter"], "user_count")
    return with_text(regroup_sum(once, ["state", "year", "brand"], ["user_count"]), {"user_count": "count_f"})


def brand_dominance(
    aggregated_user: DataFrame, brand: str, skipped_year: int = BRAND_SKIPPED_YEAR
) -> Outputs:
    """``brands``, ``rows`` of one brand, ``matrix``, ``matrix_range``."""

    def rows() -> DataFrame:
        # The brand filter stands before the sums, where it reaches the scan.
        return brand_state_year(aggregated_user.filter(F.col("brand") == brand), skipped_year)

    def cells() -> DataFrame:
        return matrix_long(rows(), "state", "year", "user_count", layers=["count_f", "brand"])

    return Outputs(
        {
            "brands": lambda: brand_totals(aggregated_user),
            "rows": rows,
            "matrix": cells,
            "matrix_range": lambda: value_range(cells(), "z"),
        }
    )


def open_rates(
    aggregated_user: DataFrame,
    map_user: DataFrame,
    brand: str,
    min_users: float = UNDERUTILIZED_MIN_USERS,
    max_rate: float = UNDERUTILIZED_MAX_RATE,
) -> Outputs:
    """``rates`` of one brand, all ``underutilized`` rows and the largest of them (``top``)."""

    def under() -> DataFrame:
        return flag_underutilized(app_open_rate(aggregated_user, map_user), min_users, max_rate)

    return Outputs(
        {
            "rates": lambda: app_open_rate(aggregated_user.filter(F.col("brand") == brand), map_user),
            "underutilized": under,
            "top": lambda: head_n(under(), "brand_users", ["state", "year", "brand"], UNDERUTILIZED_ROWS),
        }
    )


def registered_users_map(top_user_district: DataFrame, location: DataFrame) -> DataFrame:
    """Districts with their users, coordinates and marker size."""
    # One row per district, needed for its bounds first and then for its rows.
    placed = materialize(users_with_location(top_user_district, location))
    return with_text(rescale(placed, "users", "marker_size"), {"users": "users_f"}, as_double=True)


def top_users(
    map_user: DataFrame,
    top_user_district: DataFrame,
    top_user_pincode: DataFrame,
    year: int | str = ALL,
    quarter: str = ALL,
) -> Outputs:
    """``states``, ``districts`` and ``pincodes`` with the most users, fewest first as charted."""

    def charted(df: DataFrame, place: str, carry: str | None) -> DataFrame:
        top = top_places(df.withColumn(place, F.col(place).cast("string")), [place], year, quarter, carry=carry)
        return with_text(top, {"users": "users_f"}, as_double=True).orderBy("users", F.desc(place))

    return Outputs(
        {
            "states": lambda: charted(map_user, "state", None),
            "districts": lambda: charted(top_user_district, "district", "state"),
            "pincodes": lambda: charted(top_user_pincode, "pincode", "state"),
        }
    )
