"""All audit queries with their DuckDB SQL."""

from __future__ import annotations

from tallywright.plans import job_queries, metric_queries, source_queries, stat_queries, table_queries

_PARTS = (metric_queries, table_queries, stat_queries, source_queries, job_queries)


def queries() -> dict:
    """Query name to a function of (spark, sf_dir)."""
    return {name: run for part in _PARTS for name, run in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: sql for part in _PARTS for name, sql in part.S.items()}
