"""All queries of this subpackage, by name, and their SQL twins."""

from __future__ import annotations

from palimpsest.llm import queries_language, queries_neardup, queries_neighbours, queries_texts

MODULES = [queries_language, queries_neardup, queries_neighbours, queries_texts]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
