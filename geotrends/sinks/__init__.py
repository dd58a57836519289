"""Sinks: document trees, CSV, catalog tables and JDBC."""

from geotrends.sinks.json_tree import write_tree
from geotrends.sinks.tables import (
    create_tables,
    drop_tables,
    normalize_columns,
    refresh,
    register_view,
    with_surrogate_id,
    write_csv,
    write_jdbc,
)

__all__ = [
    "create_tables",
    "drop_tables",
    "normalize_columns",
    "refresh",
    "register_view",
    "with_surrogate_id",
    "write_csv",
    "write_jdbc",
    "write_tree",
]
