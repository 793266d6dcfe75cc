"""All queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from palimpsest.plans import references, search, state

MODULES = [search, state, references]
FLAGSHIP = search.hybrid_fallback_topk


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
