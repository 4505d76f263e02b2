"""The engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.plans import q_corpus, q_more, q_rules, q_search, q_texts  # noqa: F401
from quirefold.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all legs fused, the favoured tier raised, spans verified, laid out by ribbon."""
    return QUERIES["hybrid_search"](spark, sf_dir)
