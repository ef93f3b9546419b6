"""A retrieval index in the shared folder: records with their vectors, saved, loaded and rebuilt; shards with vectors beside.

A chunk shard is a folder of JSON lines, `shard=N`; every line names the row of its vector in the shard of the same number
beside it, so that text is read only for the rows that a search over vectors has picked.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import positions


def save_index(records: DataFrame, path: str) -> None:
    """One JSON line for a record; the folder appears only when all of it is written."""
    records.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of an index; a missing index has none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def rebuild_vectors(records: DataFrame, vector: Column, name: str = "embedding") -> DataFrame:
    """The index with another vector for each record; all other columns stay as they are."""
    return records.withColumn(name, vector)


def write_knowledge(chunks: DataFrame, path: str, order: list[str], shard_rows: int, vector: str = "embedding") -> None:
    """Shards of shard_rows chunks in order: JSON lines under chunks/, vectors under vectors/, both by shard and row."""
    at = F.col("position") - 1
    placed = positions(chunks.withColumn("dimension", F.size(vector)), order)
    placed = placed.withColumns({"shard": F.floor(at / shard_rows).cast("int"), "row": (at % shard_rows).cast("int")}).drop("position").repartition("shard").sortWithinPartitions("shard", "row")
    placed.select("shard", "row", vector).write.partitionBy("shard").parquet(f"{path}/vectors")
    placed.drop(vector).withColumn("embedding_at", F.struct(F.col("shard").alias("file"), "row", "dimension")).drop("row", "dimension").write.partitionBy("shard").json(f"{path}/chunks")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(shard, row, vector) of the shards that have chunks beside them."""
    shards = spark.read.text(f"{path}/chunks", wholetext=False).select("shard").distinct()
    return spark.read.parquet(f"{path}/vectors").join(shards, "shard", "left_semi")


def read_picked(spark: SparkSession, path: str, schema: str, picked: DataFrame) -> DataFrame:
    """The chunks of the picked (shard, row) alone."""
    lines = spark.read.schema(f"{schema}, embedding_at struct<file: int, row: int, dimension: int>, shard int").json(f"{path}/chunks")
    return lines.withColumn("row", F.col("embedding_at.row")).join(picked, ["shard", "row"])


def index_status(spark: SparkSession, path: str) -> tuple[bool, int, int]:
    """(available, chunks, dimension) of a folder that write_knowledge has written; anything unreadable is not available."""
    try:
        lines = spark.read.schema("embedding_at struct<file: int, row: int, dimension: int>, shard int").json(f"{path}/chunks")
        found = lines.agg(F.count(F.lit(1)).alias("n"), F.max("embedding_at.dimension").alias("dim")).first()
        spark.read.parquet(f"{path}/vectors").schema["embedding"]
    except (AnalysisException, KeyError):
        return False, 0, 0
    return bool(found["n"] and found["dim"]), found["n"], found["dim"] or 0
