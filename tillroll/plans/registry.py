"""Query registry used by ``__spark_entry__``: name -> (spark, sf_dir) ->
DataFrame, and name -> oracle SQL over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from tillroll.plans import hr_queries, landing_queries, restaurant_queries, retail_queries  # noqa: F401
