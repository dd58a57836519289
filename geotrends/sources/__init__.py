"""Sources: document trees, their extractors, and flat tables."""

from geotrends.sources.extractors import EXTRACTORS, extract, rejected_documents, rejected_elements
from geotrends.sources.json_tree import (
    parse_documents,
    read_country_tree,
    read_tree,
    split_rejects,
    with_country_path_keys,
    with_path_keys,
)
from geotrends.sources.tables import literal_rows, read_boundaries, read_csv, read_table

__all__ = [
    "EXTRACTORS",
    "extract",
    "literal_rows",
    "parse_documents",
    "read_boundaries",
    "read_country_tree",
    "read_csv",
    "read_table",
    "read_tree",
    "rejected_documents",
    "rejected_elements",
    "split_rejects",
    "with_country_path_keys",
    "with_path_keys",
]
