"""Operators: DataFrame in, DataFrame out, always lazy."""

from geotrends.operators.aggregates import (
    centroid,
    children_by_parent,
    children_parts,
    conditional_growth,
    distinct_sorted,
    grand_total,
    one_per_key,
    pad_periods,
    period_totals,
    period_trend,
    place_sums,
    rank_places,
    regroup_sum,
    totals_with_gross,
    value_range,
    with_text,
)
from geotrends.operators.hierarchy import category_tree, hierarchy_rollup
from geotrends.operators.joins import (
    app_open_rate,
    join_boundaries,
    state_priority,
    unmatched_names,
    users_with_location,
)
from geotrends.operators.matrix import matrix, matrix_long
from geotrends.operators.quality import (
    check_schema,
    column_list,
    duplicate_count,
    null_counts,
    profile_info,
)
from geotrends.operators.quantiles import exact_quantiles, iqr_bounds
from geotrends.operators.ranking import (
    head_n,
    middle_slice,
    order_by_category,
    tail_n,
    top_places,
)
from geotrends.operators.scope import (
    filter_place,
    filter_scope,
    flag_underutilized,
    latest_rows,
)
from geotrends.operators.windows import rescale, rising_places, with_log, with_previous, with_total

__all__ = [
    "app_open_rate",
    "category_tree",
    "centroid",
    "check_schema",
    "children_by_parent",
    "children_parts",
    "column_list",
    "conditional_growth",
    "distinct_sorted",
    "duplicate_count",
    "exact_quantiles",
    "filter_place",
    "filter_scope",
    "flag_underutilized",
    "grand_total",
    "head_n",
    "hierarchy_rollup",
    "iqr_bounds",
    "join_boundaries",
    "latest_rows",
    "matrix",
    "matrix_long",
    "middle_slice",
    "null_counts",
    "one_per_key",
    "order_by_category",
    "pad_periods",
    "place_sums",
    "period_totals",
    "period_trend",
    "profile_info",
    "rank_places",
    "regroup_sum",
    "rescale",
    "rising_places",
    "state_priority",
    "tail_n",
    "top_places",
    "totals_with_gross",
    "unmatched_names",
    "users_with_location",
    "value_range",
    "with_log",
    "with_previous",
    "with_text",
    "with_total",
]
