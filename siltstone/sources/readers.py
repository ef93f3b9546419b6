"""Reading text, JSON lines, vector shards and folders of files as lazy DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

#: Column names that hold text, the best first.
TEXT_COLUMNS = ("text", "content", "body", "description", "message", "question", "answer")
#: Line breaks besides those that the text source itself knows.
BREAKS = r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
HEAD_BYTES = 50 * 1024 * 1024


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line): stripped lines that are not empty; all that Python takes for a line break ends a line."""
    parts = F.explode(F.split("value", BREAKS)).alias("value")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), parts).select("file", strip(F.col("value")).alias("line"))
    return rows.filter("line != ''")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema; the first malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def source_streams(spark: SparkSession, folder: str, names: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A lazy DataFrame for each named Parquet source; optional ones only where they exist."""
    found = {}
    for name in (*names, *optional):
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception as e:  # Spark names a missing path in an analysis error
            if name not in optional or "PATH_NOT_FOUND" not in str(e):
                raise
    return found


def text_columns(df: DataFrame) -> list[str]:
    """The known text columns of df, in order of preference; else its first string column."""
    known = [c for c in TEXT_COLUMNS if c in df.columns]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not known and not strings:
        raise ValueError("no text column")
    return known or strings[:1]


def read_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".txt", ".md"), least_bytes: int = 51) -> DataFrame:
    """(file, text) of the text files below a folder; bytes that are no UTF-8 are replaced; small files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return rows.filter(ends.isin(*suffixes) & (F.col("length") >= least_bytes)).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, modified, sha256 of the first 50 MiB)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2(F.substring("content", 1, HEAD_BYTES), 256).alias("sha256"))


def read_vector_shards(spark: SparkSession, folder: str, dim: int) -> DataFrame:
    """(file, row, vector) of raw little-endian 32-bit float shards; files of another row length are skipped."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.f32").load(folder).filter(F.col("length") % (4 * dim) == 0)

    def unpack(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                m = np.frombuffer(content, "<f4").reshape(-1, dim)
                for at in range(0, len(m), 4096):
                    yield pd.DataFrame({"file": path, "row": np.arange(at, min(len(m), at + 4096)), "vector": list(m[at : at + 4096])})

    return rows.select("path", "content").mapInPandas(unpack, "file string, row long, vector array<float>")


def read_index(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of a JSON index {"records": [...]}."""
    return spark.read.schema(f"records array<struct<{record}>>").option("multiLine", True).json(path).select(F.inline("records"))
