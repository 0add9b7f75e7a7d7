"""All queries of the signal engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import compositions, conversions, kernels, spectral, streams, timedomain, long, sized  # noqa: F401, I001
from .queries.base import QUERIES, SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Mel levels of every user's events."""
    return QUERIES["mel_db"](spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
