"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchloom.plans import chains, more, stores, texts  # noqa: F401  register their queries
from watchloom.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions matched by the cascade and scored against their labels."""
    return QUERIES["mention_prf1"](spark, sf_dir)
