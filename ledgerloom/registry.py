"""All queries of the core and their SQL twins, by name."""

from __future__ import annotations

from .plans import claims, comparison, evaluation, packages, provenance, twins, verification

MODULES = (provenance, claims, verification, evaluation, comparison, packages)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in (*MODULES, twins) for k, v in getattr(m, "ORACLE", {}).items()}
