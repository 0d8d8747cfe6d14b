"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from . import flow_queries, graph_queries, model_queries, score_queries, text_queries

MODULES = (text_queries, score_queries, graph_queries, flow_queries, model_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
