"""Queries that run a stream over a table's files to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import ingest


def _result(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    ingest.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ingest.stream_table(spark, sf_dir, "text_chunks").select("chunk_id", "source", F.length("text").cast("long").alias("n_chars"))
    return _result(spark, ingest.distinct_chunks(chunks), "ingest")


def streaming_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours of the event stream: all but those that the watermark has not passed."""
    events = ingest.stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _result(spark, ingest.hourly_events(events), "hours").select(F.unix_micros("hour").alias("hour_us"), "event_type", "n", "total")


def streaming_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream appended to a log of JSON lines, and of the log the last fifty events, the newest first (a top-k report)."""
    events = ingest.stream_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    base = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    ingest.run_available(events, f"{base}/out", f"{base}/checkpoint", kind="json")
    log = spark.read.schema("event_id long, event_type string, props string").option("mode", "DROPMALFORMED").json(f"{base}/out")
    return log.orderBy(F.col("event_id").desc()).limit(50)


QUERIES = {f.__name__: f for f in (streaming_ingest, streaming_hours, streaming_audit)}
ORACLES = {
    "streaming_audit": "SELECT event_id, event_type, props FROM events ORDER BY event_id DESC LIMIT 50",
    "streaming_ingest": "SELECT DISTINCT chunk_id, source, length(text) AS n_chars FROM text_chunks",
    "streaming_hours": "WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT epoch_us(hour) AS hour_us, event_type, n, total FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
}
