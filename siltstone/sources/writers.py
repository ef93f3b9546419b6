"""Writing lines, splits, shards and metadata. Spark's commit protocol publishes a folder only when all of it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One pass, a folder for each split."""
    df.write.partitionBy(split).parquet(path)


def write_shards(df: DataFrame, path: str, order: list[str], shard_rows: int) -> None:
    """Shards of shard_rows rows in order, as JSON lines, each row with its place in its shard."""
    placed = positions(df, order).withColumn("shard", F.floor((F.col("position") - 1) / shard_rows)).withColumn("row", (F.col("position") - 1) % shard_rows).drop("position")
    placed.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").json(path)


def write_metadata(df: DataFrame, path: str) -> None:
    """A one-row aggregate as one JSON file."""
    df.coalesce(1).write.json(path)


def write_subset(df: DataFrame, columns: list[str], path: str) -> None:
    """Some columns as Parquet; a folder that is already there is left as it is."""
    df.select(*columns).write.mode("ignore").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a table's folder, all of them or none."""
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old and new by key; a key's row in new wins. Within one side the rows of a key must be equal."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    columns = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("_r")).select(key, "_r.*")
