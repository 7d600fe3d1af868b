"""Query catalog: every registered query and its DuckDB oracle."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("evaluation", "textq", "vectorq", "flows", "semq")


def _load():
    queries, sql = {}, {}
    for m in _MODULES:
        mod = import_module(f"{__name__}.{m}")
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"query {k} registered twice")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql


def all_queries():
    return _load()[0]


def all_sql():
    return _load()[1]
