"""Batch forms of the streaming aggregations: the same functions serve readStream and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetide.streaming.frames import sessions, windowed

from .base import query, r, table


@query("event_windows", "SELECT event_type, CAST(floor(epoch(time_bucket(INTERVAL 1 HOUR, ts))) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS v FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    x = windowed(table(spark, folder, "events"))
    return x.select("event_type", F.unix_timestamp("window.start").alias("start"), "n", r("v", 4).alias("v"))


@query("event_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM y GROUP BY user_id, s")
def event_sessions(spark, folder):
    x = sessions(table(spark, folder, "events"))
    return x.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")
