"""Structured Streaming over the history: the same transformation serves a stream and its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.registry import query
from annals.session import table


def tumbling(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) an hour; a watermark bounds a stream's state."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("event_id").alias("last")).select(F.col("w.start").alias("start"), "n", "last")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of each burst of a user."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(event_id, ts) once each; a stream forgets ids after the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "ts")
    return events.dropDuplicates(["event_id"]).select("event_id", "ts")


def as_times(events: DataFrame) -> DataFrame:
    """Zone-less times as UTC instants, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def out(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return out(tumbling(as_times(table(spark, sf_dir, "events"))))


@query("h AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, event_id FROM events), w AS (SELECT b AS start, event_id FROM h UNION ALL SELECT b - INTERVAL '1 hour', event_id FROM h) SELECT start, count(*) AS n, max(event_id) AS last FROM w GROUP BY start")
def events_sliding(spark, sf_dir):
    return out(sliding(as_times(table(spark, sf_dir, "events"))))


@query("""e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return out(sessions(as_times(table(spark, sf_dir, "events"))))


@query("SELECT event_id, ts FROM events")
def dedup_stream(spark, sf_dir):
    rows = as_times(table(spark, sf_dir, "events"))
    return out(deduplicated(rows.unionByName(rows)))


@query("SELECT 'refs/conv/' || conv_id AS ref, count(*) AS entries, max(turn) AS last_index FROM conversations GROUP BY 1")
def reflog_ingest(spark, sf_dir):
    from annals.plans.history import reflog

    return reflog(spark, sf_dir).groupBy("ref").agg(F.count("*").alias("entries"), F.max("update_index").alias("last_index"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '7 days'")
def retention(spark, sf_dir):
    """Entries of the last week before the newest one."""
    rows = table(spark, sf_dir, "events")
    last = rows.agg(F.max("ts").alias("newest"))
    return rows.join(F.broadcast(last), F.lit(True)).where("ts >= newest - interval 7 days").select("event_id")
