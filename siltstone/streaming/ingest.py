"""Structured Streaming jobs over files: resumable ingest with keyed deduplication, event-time windows, stateful token windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, sf_dir: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, with the schema of the files at hand."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):  # a single file: its folder is the stream
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def check_config(spark: SparkSession, path: str, config: dict) -> None:
    wanted = json.dumps(config, sort_keys=True)
    try:
        held = [r["value"] for r in spark.read.text(path).collect()]  # one line
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(path)
        return
    if held != [wanted]:
        raise ValueError(f"the run to resume has the config {held}, not {wanted}")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", kind: str = "parquet", config: dict | None = None) -> None:
    """Process what is there and stop; a second run with the same checkpoint takes up where the first one ended.

    A config is kept beside the checkpoint, and a run that would go on under another one is an error.
    """
    if config is not None:
        check_config(stream.sparkSession, f"{checkpoint}-config", config)
    query = stream.writeStream.format(kind).option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def distinct_chunks(chunks: DataFrame, seen_at: str | None = None, lateness: str = "7 days") -> DataFrame:
    """At-least-once delivery made exactly-once by key.

    Without a time column every key ever seen is kept as state, which grows with the stream; with one, a key is forgotten
    when the watermark has passed it, and copies must come within `lateness`.
    """
    if seen_at is None:
        return chunks.dropDuplicates(["chunk_id"])
    return chunks.withWatermark(seen_at, lateness).dropDuplicatesWithinWatermark(["chunk_id"])


def hourly_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Tumbling hours per event type; late events beyond the watermark are dropped."""
    counted = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def token_windows(tokens: DataFrame, block: int = 64) -> DataFrame:
    """Windows of block tokens, and the token after them, of each stream; what is left over waits for the next batch.

    `tokens` has the columns stream, at (order within the stream) and token.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, left = state.get if state.exists else (0, [])
        left = list(left)
        part = pd.concat(list(batches)).sort_values("at")
        left += part["token"].tolist()
        out = []
        while len(left) > block:
            out.append((key[0], start, left[:block], left[1 : block + 1]))
            start, left = start + block, left[block:]
        state.update((start, left))
        yield pd.DataFrame(out, columns=["stream", "start", "inputs", "targets"])

    return tokens.groupBy("stream").applyInPandasWithState(step, "stream string, start long, inputs array<long>, targets array<long>", "start long, left array<long>", "append", "NoTimeout")
