"""Registered queries of the diagnostics library and their SQL counterparts."""

from __future__ import annotations

from . import queries
from .queries import anomalies, comparisons, jobs, lookups, raw_texts, scalars, waits

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE
MODULES = (anomalies, comparisons, jobs, lookups, raw_texts, scalars, waits)
