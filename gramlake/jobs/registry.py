"""Queries over the given tables, one per operator, and their SQL where there is one."""

from __future__ import annotations

from gramlake.jobs import linear_jobs, model_jobs, resample_jobs, table_jobs

_MODULES = (linear_jobs, table_jobs, model_jobs, resample_jobs)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

flagship = linear_jobs.flagship
