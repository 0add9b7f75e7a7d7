"""Registry of queries: a name, a function of (spark, folder), and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetide.operators import signals as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The signals of the queries: values of each user's events in order. Frames of 16 samples every 4, at 64 samples a second.
SR, N, HOP = 64.0, 16, 4


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(x, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + 0.0


def sql_round(x: Column, digits: int) -> Column:
    """Rounded as the SQL does it, which rounds the product with a power of ten; F.round rounds the shortest decimal fraction
    of x, which is another number where that product lies half way between two whole ones. Without a negative zero."""
    near = F.round(x * 10.0**digits) / F.lit(10.0**digits)
    return F.when(F.abs(near) < float("inf"), near + 0.0).otherwise(x)


def wide(spark: SparkSession, folder: str) -> DataFrame:
    return S.wide_signals(table(spark, folder, "events"), "user_id", "event_id", "value")


def long(spark: SparkSession, folder: str) -> DataFrame:
    return S.long_signals(table(spark, folder, "events"), "user_id", "event_id", "value")


LONG = """l AS (SELECT user_id AS signal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS n,
 CAST(value AS DOUBLE) AS v FROM events)"""
WIDE = "s AS (SELECT user_id AS signal_id, list(CAST(value AS DOUBLE) ORDER BY event_id) AS y FROM events GROUP BY user_id)"
COUNTED = LONG + ", c AS (SELECT signal_id, count(*) AS size FROM l GROUP BY 1)"
#: Samples in frames: signal_id, t, i (place in the frame), v.
FRAMED = COUNTED + f""", fr AS (SELECT l.signal_id, CAST((n - i) / {HOP} AS BIGINT) AS t, i, v FROM l JOIN c USING (signal_id), range({N}) q(i)
 WHERE n >= i AND (n - i) % {HOP} = 0 AND n - i + {N} <= size)"""
#: Short-time spectrum with a Hann window: signal_id, t, k, re, im, and p, the power.
SPECTRUM = FRAMED + f""", fw AS (SELECT signal_id, t, i, v * (0.5 - 0.5 * cos(2 * pi() * i / {N})) AS x FROM fr),
 z AS (SELECT signal_id, t, k, sum(x * cos(2 * pi() * k * i / {N})) AS re, -sum(x * sin(2 * pi() * k * i / {N})) AS im FROM fw, range({N // 2 + 1}) q(k) GROUP BY ALL),
 p AS (SELECT signal_id, t, k, re * re + im * im AS p, k * {SR / N} AS f FROM z)"""


def values(name: str, columns: str, rows) -> str:
    """A table of constants for SQL."""
    body = ", ".join("(" + ", ".join(repr(float(x)) if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) q({columns}))"
