"""Queries that run through Structured Streaming; their SQL is on the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import read
from corpusloom.streaming import live


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM (SELECT DISTINCT user_id, event_id, ts FROM events) GROUP BY user_id")
def stream_upsert_latest(spark, d):
    s = live.file_stream(spark, f"{d}/events.parquet").select("user_id", "event_id", "ts")
    return live.upsert_once(s, ["user_id"], ["ts"])


@query("SELECT id, resolved_at IS NOT NULL AS resolved FROM unaccepted_qa QUALIFY row_number() OVER (PARTITION BY id ORDER BY resolved_at DESC NULLS LAST) = 1")
def stream_feedback_state(spark, d):
    s = live.file_stream(spark, f"{d}/unaccepted_qa.parquet").select("id", (F.col("resolved_at").isNotNull()).alias("resolved"), "created_at", F.coalesce(F.col("resolved_at"), F.col("created_at")).alias("at"))
    return live.upsert_once(s, ["id"], ["resolved", "at"]).select("id", "resolved")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, d):
    """Counts by day and type, with a watermark; the table is one file, so none of it comes too late."""
    s = live.file_stream(spark, f"{d}/events.parquet")
    return live.counted_once(s.withColumn("ts", F.col("ts").cast("timestamp")), time="ts", key="event_type", value="value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY event_type")
def stream_totals(spark, d):
    """Totals by type out of the windows of a stream."""
    s = live.file_stream(spark, f"{d}/events.parquet")
    w = live.counted_once(s.withColumn("ts", F.col("ts").cast("timestamp")), time="ts", key="event_type", value="value")
    return w.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))


@query("SELECT DISTINCT user_id FROM events WHERE ts IS NOT NULL")
def stream_new_users(spark, d):
    """Users at their first event within the watermark, which is longer than the table."""
    s = live.file_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return live.run_once(live.new_keys(s, "user_id", time="ts", delay="4000 days").select("user_id"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e),
g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, s)
SELECT * FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_sessions(spark, d):
    """Sessions of a stream that the watermark has closed: those that ended an hour before the last event or earlier."""
    s = live.file_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    out = live.run_once(live.sessions(s))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, s
""")
def idle_sessions(spark, d):
    return live.sessions(read(spark, d, "events"))


@query("""
SELECT user_id AS stream_id, event_type AS event, count(*) AS frames FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL GROUP BY ALL
""")
def event_frames(spark, d):
    """Events written as frames of lines (event, data, blank) and put together again."""
    e = read(spark, d, "events").where("event_type is not null and props is not null")
    line = F.posexplode(F.array(F.concat(F.lit("event: "), F.col("event_type")), F.concat(F.lit("data: "), F.col("props")), F.lit(""))).alias("nth", "line")
    lines = e.select(F.col("user_id").alias("stream_id"), "event_id", line).select("stream_id", (F.col("event_id") * 3 + F.col("nth")).alias("seq"), "line")
    return live.frames(lines).groupBy("stream_id", "event").agg(F.count("*").alias("frames"))
