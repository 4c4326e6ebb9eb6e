"""The queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that holds it.
_QUERIES = {
    "op1_token_store": "token_store",
    "op2_secret_spans": "secrets",
    "op3_near_duplicates": "near_duplicates",
    "op4_packed_sequences": "packing",
    "op5_source_mix": "mixing",
    "op6_ppm_scores": "scoring",
    "op7_quality_rules": "quality",
    "op8_main_text": "html_text",
    "op9_hilbert_shards": "sharding",
    "op10_permutation_neighbours": "neighbours",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"cohortal.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from cohortal.llm.oracles import SQL

    return {name: sql for name, sql in SQL.items() if name in _QUERIES}
