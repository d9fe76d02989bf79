"""Registered queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import field_queries, layer_queries, overlay_queries, pixel_queries, profiles, ring_queries, season_queries, series_queries, stat_queries

_PLANS = [profiles, series_queries, field_queries, stat_queries, season_queries, ring_queries, pixel_queries, overlay_queries, layer_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
