"""All queries of the library and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_detect", "q_names", "q_general", "q_review", "q_evaluate", "q_quality"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"sluier.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"sluier.plans.{m}").ORACLES.items()}
