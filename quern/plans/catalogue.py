"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from quern.plans import domain_queries, general, relation_queries, scalar_queries, window_queries

_MODULES = (general, scalar_queries, relation_queries, window_queries, domain_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
