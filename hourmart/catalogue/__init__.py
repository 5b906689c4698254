"""Operators applied to the shared test tables, each with its SQL counterpart."""

from __future__ import annotations

from hourmart.catalogue import (
    chain_queries, feature_queries, job_queries, model_queries, report_queries, serving_queries, star_queries,
    stream_queries, write_queries,
)

_MODULES = (
    star_queries, feature_queries, serving_queries, write_queries, report_queries,
    job_queries, model_queries, chain_queries, stream_queries,
)


def all_queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
