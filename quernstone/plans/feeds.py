"""Queries of feeds, windows and sessions; q_stream_* run as streams, the others on batches. Their SQL is the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.session import ensure_checkpoint_dir
from quernstone.sources.tables import table
from quernstone.streaming import feeds


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_latest_day(spark, d):
    """Distinct events of the stream, by type and day."""
    out = feeds.run_to_table(feeds.deduplicated(feeds.event_stream(spark, f"{d}/events.parquet").select("event_id", "event_type", "ts"), "event_id", "ts", "60 days"))
    return out.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def q_stream_frontier(spark, d):
    """Ingested by frontier and key from the stream: events counted by type."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    feeds.ingest(feeds.event_stream(spark, f"{d}/events.parquet"), f"{base}/out", "event_id", "ts", "event_type", f"{base}/state")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


def q_stream_windows(spark, d):
    """Counts of the stream by day and type, each emitted when its result changes."""
    w = feeds.run_to_table(feeds.windowed_counts(feeds.event_stream(spark, f"{d}/events.parquet"), "1 day"), "complete")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def q_stream_sessions(spark, d):
    """Sessions of the stream by user, emitted when the watermark has passed them or the stream's result is complete."""
    s = feeds.run_to_table(feeds.sessions(feeds.event_stream(spark, f"{d}/events.parquet"), "6 hours", "60 days"), "complete")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def q_window_counts(spark, d):
    w = feeds.windowed_counts(_events(spark, d), "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def q_sessions(spark, d):
    s = feeds.sessions(_events(spark, d), "6 hours")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def q_event_page(spark, d):
    """Fourth page of the error events, oldest first."""
    from quernstone.operators.rows import page

    return page(table(spark, d, "events").where("event_type = 'error'"), [F.asc("ts"), F.asc("event_id")], 4).select("event_id", "user_id")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLE = {
    "q_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "q_stream_latest_day": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2",
    "q_stream_frontier": "SELECT event_type, count(DISTINCT event_id) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
    "q_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "q_sessions": "SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY 1, 2) GROUP BY 1",
    "q_event_page": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 50 OFFSET 150",
}
ORACLE["q_stream_sessions"] = ORACLE["q_sessions"]
