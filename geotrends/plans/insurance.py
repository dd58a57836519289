"""Insurance: hot spots on the map and states by priority."""

from pyspark.sql import DataFrame

from geotrends.fixed_values import GROWTH_BASE_YEAR, GROWTH_YEAR, SEGMENT_GROWTH, SEGMENT_VOLUME, SEGMENTS
from geotrends.operators.aggregates import centroid, conditional_growth, with_text
from geotrends.operators.hierarchy import category_tree
from geotrends.operators.joins import state_priority
from geotrends.operators.ranking import order_by_category
from geotrends.plans.outputs import Outputs


def insurance_hot_spots(country_location: DataFrame) -> Outputs:
    """``points`` of the map and its ``center``."""
    return Outputs(
        {
            "points": lambda: country_location.select("state", "latitude", "longitude", "metric"),
            "center": lambda: centroid(country_location),
        }
    )


def prioritise_states(
    aggregated_insurance: DataFrame,
    map_insurance: DataFrame,
    cur: int = GROWTH_YEAR,
    base: int = GROWTH_BASE_YEAR,
    min_growth: float = SEGMENT_GROWTH,
    min_volume: float = SEGMENT_VOLUME,
) -> Outputs:
    """``growth`` per state, ``states`` with their segment in order, and the segment ``tree``."""
    growth = conditional_growth(aggregated_insurance, cur=cur, base=base)

    def segments() -> DataFrame:
        return state_priority(growth, map_insurance, min_growth, min_volume)

    def states() -> DataFrame:
        texts = with_text(segments(), {"total_volume": "volume_f"}, as_double=True)
        return order_by_category(texts, "state_category", SEGMENTS, "state")

    return Outputs({"growth": lambda: growth, "states": states, "tree": lambda: category_tree(segments())})
