"""Every query of the library by name, with its oracle."""

from __future__ import annotations

from . import claim_queries, date_queries, page_queries, register_queries, source_queries, text_queries, way_queries, work_queries

_MODULES = (text_queries, date_queries, register_queries, work_queries, claim_queries, page_queries, way_queries, source_queries)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
