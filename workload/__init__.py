"""Queries over the given tables, each with its DuckDB twin."""

from importlib import import_module

MODULES = ["q_scalars", "q_filters", "q_aggregates", "q_places", "q_ingest", "q_tables", "q_analyses"]


def load_all() -> None:
    """Register all queries."""
    for name in MODULES:
        import_module(f"workload.{name}")
