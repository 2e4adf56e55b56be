"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query: module of this package that defines it
MODULES = {
    "op1_jaccard_join": "jaccard_join",
    "op2_html_extract": "html_extract",
    "op3_url_filter": "url_filter",
    "op4_token_files": "token_files",
    "op5_embedding_dedup": "embedding_dedup",
    "op6_ann": "ann",
    "op7_language_id": "language_id",
    "op8_quality": "quality",
    "op9_packing": "packing",
    "op10_mixing": "mixing",
}


def queries() -> dict:
    return {name: getattr(import_module(f"loam.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"loam.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
