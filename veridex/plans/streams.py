"""Batch twins of the streaming extension, checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import incremental


@query("tumbling_counts", "SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = incremental.tumbling(table(spark, sf_dir, "events"))
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_counts", """
WITH e AS (SELECT event_type, date_trunc('day', ts) AS d FROM events), s AS (SELECT event_type, d FROM e UNION ALL SELECT event_type, d - INTERVAL 1 DAY FROM e)
SELECT CAST(d AS DATE)::VARCHAR AS start, event_type, count(*) AS n FROM s GROUP BY ALL""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = incremental.sliding(table(spark, sf_dir, "events"))
    return s.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("session_windows", """
WITH o AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = incremental.sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n", F.round("total", 4).alias("total"))
