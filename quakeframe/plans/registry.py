"""All registered queries with their SQL."""

from __future__ import annotations

from quakeframe.plans import file_queries, more_queries, pick_queries, record_queries, trial_queries, usage_queries, wave_queries

MODULES = (pick_queries, trial_queries, wave_queries, record_queries, more_queries, usage_queries, file_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
