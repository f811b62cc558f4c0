"""Queries over windows and incremental runs of ``events`` and ``conversations``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from briefloom.plans.registry import query
from briefloom.plans.views import NOW_MS, table
from briefloom.streaming import incremental


def stream(spark, d, name):
    """A table's file, or its folder of files, as a stream source; the path is a glob, as the source asks for one."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def stamped(events):
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("tumbling_day", "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tumbling_day(spark, d):
    return incremental.cn_days(stamped(table(spark, d, "events")), "ts").withColumn("total", F.round("total", 4))


@query("sliding_7d", "SELECT strftime(s, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY 1")
def sliding_7d(spark, d):
    out = incremental.sliding(stamped(table(spark, d, "events")), "ts", "7 days", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("session_gap", "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1")
def session_gap(spark, d):
    out = incremental.sessions(stamped(table(spark, d, "events")), "user_id", "ts", "2 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("late_audit", "SELECT event_type, count(*) AS n, count(*) FILTER (ts <= TIMESTAMP '2024-01-24' AND value <= 90) AS late FROM events GROUP BY 1")
def late_audit(spark, d):
    tagged = incremental.tagged_late(stamped(table(spark, d, "events")), "ts", F.timestamp_millis(F.lit(NOW_MS)), F.lit(168), F.col("value") > 90)
    return tagged.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


@query("poll_gate", f"SELECT event_id, ({NOW_MS} - (epoch_ms(ts)) >= CASE WHEN event_id % 2 = 0 THEN 2 ELSE 4 END * 3600000) AS due FROM events")
def poll_gate(spark, d):
    tier = F.when(F.col("event_id") % 2 == 0, "P0").otherwise("P1")
    return stamped(table(spark, d, "events")).select("event_id", incremental.poll_due(F.unix_millis("ts"), tier, NOW_MS).alias("due"))


@query("dedup_watermark", "SELECT user_id FROM events GROUP BY user_id")
def dedup_watermark(spark, d):
    out = incremental.first_seen(stamped(stream(spark, d, "events")), "user_id", "ts", "60 days").select("user_id")
    return incremental.drain(out, f"dedup_{uuid.uuid4().hex}")


@query("stream_new_items", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def stream_new_items(spark, d):
    items = stream(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("key"))
    stored = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return incremental.drain(incremental.new_against(items, stored, "key").select("event_id"), f"new_{uuid.uuid4().hex}")


@query("stream_threads", "SELECT conv_id, count(*) AS posts, CAST(sum(length(text)) AS BIGINT) AS characters, max(turn) AS last_turn FROM conversations GROUP BY 1")
def stream_threads(spark, d):
    posts = stream(spark, d, "conversations").select("conv_id", "turn", "text")
    seen = incremental.drain(incremental.threads(posts, "conv_id"), f"threads_{uuid.uuid4().hex}", "update")
    return seen.groupBy("conv_id").agg(F.max("posts").alias("posts"), F.max("characters").alias("characters"), F.max("last_turn").alias("last_turn"))


@query("stream_quiet_threads", """WITH s AS (
  SELECT user_id, ts, event_id, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)
), g AS (
  SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS quiet_at, count(*) AS posts, string_agg(event_type, ' ' ORDER BY event_id) AS kinds FROM s GROUP BY user_id, session
)
SELECT user_id, epoch_us(started) AS started_us, posts, kinds FROM g WHERE epoch_ms(quiet_at) <= (SELECT epoch_ms(max(ts)) FROM events) - 3600000""")
def stream_quiet_threads(spark, d):
    """Events of a user as the posts of threads; those that are quiet by the end of the stream, less an hour."""
    posts = stamped(stream(spark, d, "events")).select("user_id", "ts", "event_id", "event_type")
    closed = incremental.drain(incremental.quiet_threads(posts, "user_id", "ts", "event_id", "event_type", "2 hours", "1 hour"), "quiet_threads")
    kinds = F.array_join(F.transform("posts", lambda p: p["text"]), " ")
    return closed.select("user_id", F.unix_micros("started").alias("started_us"), F.size("posts").cast("long").alias("posts"), kinds.alias("kinds"))
