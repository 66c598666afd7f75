"""All core queries and their SQL, by name."""

from __future__ import annotations

from siftgrain.plans import change_queries, corpus_queries, evidence_queries, more_queries, problems, routing_queries, search_queries, structure_queries, workspace_queries

_MODULES = (problems, search_queries, corpus_queries, more_queries, routing_queries, change_queries, structure_queries, workspace_queries, evidence_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
