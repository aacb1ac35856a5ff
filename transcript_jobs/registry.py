"""The registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from transcript_jobs import flow_queries
from transcript_jobs.queries import REGISTERED

assert flow_queries  # its import registers the queries of flows


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
