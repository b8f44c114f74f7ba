"""Every registered query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from corpusloom.plans import evaluation_queries, graph_queries, lake_queries, region_queries, retrieval_queries, stream_queries  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
