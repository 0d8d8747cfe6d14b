"""Operators for training-data pipelines; nothing outside this subpackage imports it."""

from __future__ import annotations

from . import dressed, groups, leakage, lookalike, packing, sentences, splitting, truncation

MODULES = (groups, truncation, sentences, splitting, dressed, packing, leakage, lookalike)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
