"""Named queries of the engine, each with oracle SQL where SQL can express it."""

from __future__ import annotations

from . import adjustment, cohort, entities, normal, record, serving, streams

MODULES = (cohort, record, entities, normal, serving, adjustment, streams)


def queries() -> dict:
    """All queries by name."""
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by query name."""
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
