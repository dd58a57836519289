"""Places by transaction volume: high and low, rising, and as a hierarchy."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import ALL, RISING_MAX_PREVIOUS, RISING_MIN_GROWTH
from geotrends.operators.aggregates import place_sums, with_text
from geotrends.operators.hierarchy import hierarchy_rollup
from geotrends.operators.ranking import head_n, middle_slice, tail_n
from geotrends.operators.scope import filter_place
from geotrends.operators.windows import rising_places
from geotrends.plans.outputs import Outputs

_TEXTS = {"count": "count_f", "amount": "amount_f"}


def volume_places(df: DataFrame, places: Sequence[str], year: int | str = ALL) -> Outputs:
    """``all`` places by volume, and the ``top``, ``moderate`` and ``bottom`` ones.

    ``places`` is ``["state"]``, ``["state", "district"]`` or
    ``["state", "pincode"]``. Moderate is what is left between both ends.
    """
    if "pincode" in places:
        df = df.withColumn("pincode", F.col("pincode").cast("string"))
    sums = place_sums(df, places, year)

    def charted(part: DataFrame, upwards: bool) -> DataFrame:
        # Charts read upwards: top and moderate places are listed smallest first.
        order = [F.asc("count"), *[F.desc(p) for p in places]] if upwards else [F.desc("count"), *places]
        return with_text(part, _TEXTS, as_double=True).orderBy(*order)

    return Outputs(
        {
            "all": lambda: charted(sums, False),
            "top": lambda: charted(head_n(sums, "count", places), True),
            "moderate": lambda: charted(middle_slice(sums, "count", places), True),
            "bottom": lambda: charted(tail_n(sums, "count", places), False),
        }
    )


def rising_districts(
    map_transaction: DataFrame, max_prev: float = RISING_MAX_PREVIOUS, min_growth: float = RISING_MIN_GROWTH
) -> DataFrame:
    """Districts whose yearly count grew strongly from a small base."""
    return rising_places(map_transaction, "transaction_count", max_prev, min_growth)


def volume_hierarchy(top_transaction_district: DataFrame, state: str = ALL, district: str = ALL) -> DataFrame:
    """Transaction count along state, district, year and quarter, with shares.

    A chosen district starts the path at the district.
    """
    scoped = filter_place(top_transaction_district, state, district)
    path = ["district", "year", "quarter"] if district != ALL else ["state", "district", "year", "quarter"]
    return hierarchy_rollup(scoped, path, "transaction_count")
