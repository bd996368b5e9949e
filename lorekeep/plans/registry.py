"""Queries over the driver tables and their oracle SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, bundles, changes, exchange, ingest, recall, retrieval, reviews, texts, workspace

_MODULES = (texts, analytics, retrieval, reviews, workspace, exchange, ingest, recall, changes, bundles)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
