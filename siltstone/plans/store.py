"""Queries on the application's tables: conversations, messages, events, sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from ..session import table

LAST_TURNS = 4
TODAY = "2026-09-15"


def latest_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty conversations whose latest id is highest (a top-k report)."""
    rows = table(spark, sf_dir, "messages").filter("conversation_id is not null").groupBy("conversation_id").agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("messages"))
    return rows.orderBy(F.col("last_id").desc(), "conversation_id").limit(50)


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last messages of each conversation; the window keeps only that many per group before it shuffles."""
    newest = Window.partitionBy("conversation_id").orderBy(F.col("id").desc())
    rows = table(spark, sf_dir, "messages").filter("conversation_id is not null").select("conversation_id", "id", F.row_number().over(newest).cast("long").alias("turn_from_end"))
    return rows.filter(F.col("turn_from_end") <= LAST_TURNS)


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages left after the conversations that hold a tool message are deleted."""
    rows = table(spark, sf_dir, "messages")
    gone = rows.filter(F.lower(F.trim("role")) == "tool").select("conversation_id").distinct()
    return rows.join(gone, "conversation_id", "left_anti").select("id", "conversation_id")


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "messages").select("conversation_id", F.lower(F.trim("role")).alias("role"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("conversation_id").alias("conversations"))


def model_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and greatest latency per model, from the messages' JSON metadata."""
    rows = table(spark, sf_dir, "messages").select(F.get_json_object("metadata", "$.model").alias("model"), F.get_json_object("metadata", "$.latency_ms").try_cast("long").alias("ms")).filter("model is not null")
    return rows.groupBy("model").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.max("ms").alias("max_ms"))


def date_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by age on a given day."""
    days = F.datediff(F.lit(TODAY).cast("date"), F.col("created_at").cast("date"))
    bucket = F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "this week").otherwise("older")
    return table(spark, sf_dir, "documents").filter("created_at is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("documents"))


def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty events, the newest first (a top-k report); unreadable JSON is dropped."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")).filter("k is not null")
    return rows.orderBy(F.col("event_id").desc()).limit(50)


def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"), F.countDistinct("user_id").alias("users"))


def sensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pressure_sensor_data").select(F.upper(F.trim("sensor_id")).alias("sensor"), "pressure_bar")
    return rows.groupBy("sensor").agg(F.count("pressure_bar").alias("n"), F.round(F.avg("pressure_bar"), 6).alias("mean_bar"), F.min("pressure_bar").alias("min_bar"), F.max("pressure_bar").alias("max_bar"))


def sensor_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings, sensors and summed flow of each day and status."""
    rows = table(spark, sf_dir, "pressure_sensor_data").select(F.to_date("ts").cast("string").alias("day"), "status", "sensor_id", "flow_m3h")
    return rows.groupBy("day", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.upper(F.trim("sensor_id"))).alias("sensors"), F.sum(F.round(F.col("flow_m3h") * 100).cast("long")).alias("flow_hundredths"))


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type so far, and the running total of their values in cents."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return positions(rows, ["ts", "event_id"], ["event_type"], {"total": F.col("cents")}).select("event_id", "position", F.col("total").cast("long").alias("total_cents"))


QUERIES = {f.__name__: f for f in (latest_conversations, last_turns, delete_cascade, role_counts, model_latency, date_buckets, audit_tail, audit_json, sensor_stats, sensor_hours, running_total)}

ORACLES = {
    "latest_conversations": "SELECT conversation_id, max(id) AS last_id, count(*) AS messages FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1 ORDER BY last_id DESC, conversation_id LIMIT 50",
    "last_turns": f"WITH r AS (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS turn_from_end FROM messages WHERE conversation_id IS NOT NULL) SELECT * FROM r WHERE turn_from_end <= {LAST_TURNS}",
    "delete_cascade": "SELECT id, conversation_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages t WHERE t.conversation_id = m.conversation_id AND lower(trim(t.role)) = 'tool')",
    "role_counts": "SELECT lower(trim(role)) AS role, count(*) AS messages, count(DISTINCT conversation_id) AS conversations FROM messages GROUP BY 1",
    "model_latency": "SELECT metadata->>'$.model' AS model, count(CAST(metadata->>'$.latency_ms' AS BIGINT)) AS n, round(avg(CAST(metadata->>'$.latency_ms' AS BIGINT)), 4) AS mean_ms, max(CAST(metadata->>'$.latency_ms' AS BIGINT)) AS max_ms FROM messages WHERE metadata->>'$.model' IS NOT NULL GROUP BY 1",
    "date_buckets": f"WITH r AS (SELECT DATE '{TODAY}' - CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS days FROM documents WHERE created_at IS NOT NULL) SELECT CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN 'this week' ELSE 'older' END AS bucket, count(*) AS documents FROM r GROUP BY 1",
    "audit_tail": "SELECT event_id, event_type, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE TRY_CAST(props->>'$.k' AS BIGINT) IS NOT NULL ORDER BY event_id DESC LIMIT 50",
    "audit_json": "SELECT event_type, count(TRY_CAST(props->>'$.k' AS BIGINT)) AS n, CAST(sum(TRY_CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "sensor_stats": "SELECT upper(trim(sensor_id)) AS sensor, count(pressure_bar) AS n, round(avg(pressure_bar), 6) AS mean_bar, min(pressure_bar) AS min_bar, max(pressure_bar) AS max_bar FROM pressure_sensor_data GROUP BY 1",
    "sensor_hours": "SELECT CAST(CAST(ts AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, status, count(*) AS n, count(DISTINCT upper(trim(sensor_id))) AS sensors, CAST(sum(CAST(round(flow_m3h * 100) AS BIGINT)) AS BIGINT) AS flow_hundredths FROM pressure_sensor_data GROUP BY 1, 2",
    "running_total": "WITH r AS (SELECT event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events) SELECT event_id, row_number() OVER w AS position, CAST(sum(cents) OVER w AS BIGINT) AS total_cents FROM r WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
}
