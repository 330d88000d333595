"""All queries of the core, gathered from the modules of this package."""

from __future__ import annotations

from quarryspan.plans import composed, identity, more, packs, providers, quality, ranking, references, scoring, sources, streams, structured, text

MODULES = [references, text, scoring, ranking, identity, quality, sources, streams, structured, more, composed, packs, providers]
FLAGSHIP = references.p6_found


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.ORACLE.items()}
