"""Event-time windows, the same functions for batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; on a stream rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, stop, n): runs of a user's events with no longer pause than ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *times: str) -> DataFrame:
    """Times as microseconds, so that no engine's time zone matters."""
    return df.withColumns({t: F.unix_micros(t) for t in times})


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windowed(_events(spark, sf_dir), "1 hour").withColumn("total", F.round("total", 4)), "start")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(windowed(_events(spark, sf_dir), "2 hours", "1 hour").withColumn("total", F.round("total", 4)), "start")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(session_windows(_events(spark, sf_dir), "30 minutes"), "start", "stop")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-10: the pause before each event of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select("event_id", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)).alias("gap"))


def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-02 by event time: the last event of each user."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count(F.lit(1)).alias("n"))


ORACLES = {
    "events_tumbling": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) - k * 3600000000 AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL",
    "events_sessions": """WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) SELECT user_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) + 1800000000 AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
    "events_gaps": "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events",
    "events_latest_decisions": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id",
}
