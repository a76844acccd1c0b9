"""Queries of the engine's own operators, and their DuckDB SQL.

``@query(sql)`` registers a function of ``(spark, sf_dir)`` under its name; ``sql`` may use the derived
views by name, and is left out where SQL can't express the operator.
"""

from __future__ import annotations

import importlib

from .views import with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = with_views(sql)
        return function

    return add


for _name in ("raster_queries", "catalog_queries", "admission_queries", "log_queries", "evaluation_queries", "stream_queries"):
    importlib.import_module(f"skyledger.plans.{_name}")
