"""Analyses: what a user calls. Each returns named, lazy DataFrames."""

from geotrends.plans.home import home_overview
from geotrends.plans.insurance import insurance_hot_spots, prioritise_states
from geotrends.plans.payments import payment_modes
from geotrends.plans.places import rising_districts, volume_hierarchy, volume_places
from geotrends.plans.refresh import extract_tables, profile_tables, refresh_from_tree
from geotrends.plans.users import (
    brand_dominance,
    open_rates,
    registered_users_map,
    top_users,
    user_engagement,
)

__all__ = [
    "brand_dominance",
    "extract_tables",
    "home_overview",
    "insurance_hot_spots",
    "open_rates",
    "payment_modes",
    "prioritise_states",
    "profile_tables",
    "refresh_from_tree",
    "registered_users_map",
    "rising_districts",
    "top_users",
    "user_engagement",
    "volume_hierarchy",
    "volume_places",
]
