"""Queries of the engine's own operators, each with the SQL it must equal."""

from __future__ import annotations

from importlib import import_module

from loam.plans.registry import QUERIES, SQL

for _name in ("corpus", "retrieval", "generation", "programs", "tables"):
    import_module(f"loam.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
