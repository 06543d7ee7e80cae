"""Queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame,
and name -> oracle SQL where SQL can say the same."""

from __future__ import annotations

import re

from tillroll.llm import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict:
    return {k: v for k, v in _queries.ORACLE.items() if re.fullmatch(r"op\d+_\w+", k)}
