"""The operators' queries over the whole given tables, with SQL where it can express them."""

from importlib import import_module

import corpus_pipeline
from geotrends.llm.registry import LLM_ORACLES, LLM_QUERIES, query

MODULES = [
    "q_backoff",
    "q_decontaminate",
    "q_warc",
    "q_licenses",
    "q_packing",
    "q_vectors",
    "q_quality",
    "q_url_rules",
    "q_near_dups",
    "q_repeats",
    "q_main_text",
    "q_lloyd",
    "q_collocations",
]

for _name in MODULES:
    import_module(f"geotrends.llm.{_name}")

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
