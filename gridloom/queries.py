"""Queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import data_queries, format_queries, graph_queries, network_queries, overlay_queries, tag_queries

_GROUPS = (overlay_queries, tag_queries, graph_queries, network_queries, format_queries, data_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for g in _GROUPS for k, v in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for g in _GROUPS for k, v in g.SQL.items()}
