"""All queries of the engine by name, with the SQL that an independent database can run."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("tpch", "catalog", "more", "semantics")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"millrace.plans.{name}"), attribute)
        if twice := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= part
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
