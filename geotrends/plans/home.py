"""Overview: three totals and three trends."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import FIRST_INSURANCE_PERIOD
from geotrends.operators.aggregates import grand_total, pad_periods, period_trend, with_text
from geotrends.plans.outputs import Outputs
from geotrends.sources.tables import literal_rows


def _total(df: DataFrame, measure: str, metric: str) -> DataFrame:
    return grand_total(df, {measure: "total"}).select(F.lit(metric).alias("metric"), "total")


def insurance_plot(trend: DataFrame) -> DataFrame:
    """The insurance trend with the empty first quarter put before it."""
    spark = trend.sparkSession
    first = literal_rows(spark, [FIRST_INSURANCE_PERIOD], "year INT, quarter STRING, count BIGINT, amount DOUBLE")
    padded = pad_periods(trend.select(*first.columns), first)
    return with_text(padded, {"count": "count_f", "amount": "amount_f"}, as_double=True)


def home_overview(
    map_user: DataFrame,
    aggregated_transaction: DataFrame,
    map_insurance: DataFrame,
    aggregated_insurance: DataFrame,
) -> Outputs:
    """``totals``, ``user_trend``, ``transaction_trend``, ``insurance_trend``, ``insurance_plot``."""

    def totals() -> DataFrame:
        return with_text(
            _total(map_user, "registered_users", "registered_users")
            .unionByName(_total(aggregated_transaction, "transaction_count", "transactions"))
            .unionByName(_total(map_insurance, "insurance_count", "insurance_transactions")),
            {"total": "total_f"},
            as_double=True,
        )

    def user_trend() -> DataFrame:
        trend = period_trend(map_user, {"registered_users": "user_count", "appopen_count": "open_count"})
        return with_text(trend, {"user_count": "user_counts_f", "open_count": "open_counts_f"}, as_double=True)

    def transaction_trend() -> DataFrame:
        names = {
            "transaction_count": "number_of_transactions",
            "transaction_amount": "total_transaction_amount",
        }
        trend = period_trend(aggregated_transaction, names)
        return with_text(trend, {name: f"{name}_f" for name in names.values()}, as_double=True)

    def insurance_trend() -> DataFrame:
        return period_trend(aggregated_insurance, {"insurance_count": "count", "insurance_amount": "amount"})

    return Outputs(
        {
            "totals": totals,
            "user_trend": user_trend,
            "transaction_trend": transaction_trend,
            "insurance_trend": insurance_trend,
            "insurance_plot": lambda: insurance_plot(insurance_trend()),
        }
    )
