"""All queries of this subpackage."""

from __future__ import annotations

from quarryspan.llm import queries_documents, queries_groups, queries_languages, queries_summaries

MODULES = [queries_summaries, queries_groups, queries_languages, queries_documents]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.ORACLE.items()}
