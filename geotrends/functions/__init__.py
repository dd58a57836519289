"""Scalar functions: plain ``Column`` expressions, no Python UDFs."""

from geotrends.functions.numbers import (
    human_number,
    money_sum,
    pct_change,
    round2,
    safe_ratio,
    segment,
    truncate_int,
)
from geotrends.functions.text import (
    canonical_state,
    clean_district,
    clean_state_label,
    place_year_label,
    quarter_tag,
    title_case,
)

__all__ = [
    "canonical_state",
    "clean_district",
    "clean_state_label",
    "human_number",
    "money_sum",
    "pct_change",
    "place_year_label",
    "quarter_tag",
    "round2",
    "safe_ratio",
    "segment",
    "title_case",
    "truncate_int",
]
