"""Exact top-k vector search: a stated query set against all rows, in blocks.

Data rows stay where they are: every task scores its Arrow batches against the queries by matrix products and keeps its k best
rows for each query; a window over these partial results gives the final ranks. Queries are sent to the tasks where they hold
at most QUERY_NUMBERS numbers. A larger query set stays a table of blocks of QUERY_BLOCK vectors; data rows are then gathered
into blocks too, and both meet in a join on (query block, slice of the data), so no key holds more than a slice.

Scores are rounded to DECIMALS, so that equal vectors tie whatever block they are multiplied in.

Defined results: null vectors, and vectors of another dimension than `dim`, are skipped; a zero vector has cosine 0 to all;
ties go to the lower id, or to the higher with `ties="high"`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_NUMBERS = 4_000_000
QUERY_BLOCK = 256
DATA_BLOCK = 2048
SLICES = 16
DECIMALS = 10


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _best_of(ids: np.ndarray, scores: np.ndarray, k: int, ties: str) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores: places and scores, best first."""
    if scores.shape[1] > 4 * k:  # all that tie with the k-th stay, so that ids decide among them
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep = (scores >= least[:, None]).any(0)
        ids, scores = ids[keep], scores[:, keep]
    order = np.lexsort((np.broadcast_to(ids if ties == "low" else -ids, scores.shape), -scores), axis=1)[:, :k]
    return ids[order], np.take_along_axis(scores, order, 1)


def _scores(q: np.ndarray, x: np.ndarray, cosine: bool) -> np.ndarray:
    scores = q @ x.T
    if cosine:
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        scores = np.where(norms > 0, scores / np.where(norms > 0, norms, 1), 0.0)
    return np.round(scores, DECIMALS)


def _rows(names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.repeat(names, ids.shape[1]), "id": ids.ravel(), "score": scores.ravel()})


def _against(names: np.ndarray, q: np.ndarray, k: int, cosine: bool, ties: str):
    """The k best rows of a task for each query, over all its batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for pdf in batches:
            if not len(pdf):
                continue
            for at in range(0, len(q), QUERY_BLOCK):
                part = slice(at, at + QUERY_BLOCK)
                new_ids, new = _best_of(pdf["id"].to_numpy(), _scores(q[part], _matrix(pdf["vector"]), cosine), k, ties)
                if at == 0:
                    all_ids, all_new = np.zeros((len(q), new.shape[1]), np.int64), np.zeros((len(q), new.shape[1]))
                all_ids[part], all_new[part] = new_ids, new
            ids, scores = np.concatenate([ids, all_ids], axis=1), np.concatenate([scores, all_new], axis=1)
            order = np.lexsort((ids if ties == "low" else -ids, -scores), axis=1)[:, :k]
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        if ids.shape[1]:
            yield _rows(names, ids, scores)

    return run


def _block_against_block(k: int, cosine: bool, ties: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield _rows(np.asarray(r.query_ids), *_best_of(np.asarray(r.ids), _scores(_matrix(r.query_vectors), _matrix(r.vectors), cosine), k, ties))

    return run


def _blocked(df: DataFrame, size: int, rows: int) -> DataFrame:
    """Rows gathered into blocks of about `size` by hash: (block, rows)."""
    n = max(1, -(-rows // size))
    return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("rows"))


def vector_top_k(data: DataFrame, queries: DataFrame, k: int, dim: int, cosine: bool = True, ties: str = "low") -> DataFrame:
    """(query_id, id, score, rank) over data(id, vector) and queries(id, vector)."""
    data, queries = (df.select(F.col("id").cast("long").alias("id"), "vector").filter((F.size("vector") == dim) & F.col("id").isNotNull()) for df in (data, queries))
    n = queries.count()
    schema = "query_id long, id long, score double"
    if n * dim <= QUERY_NUMBERS:
        asked = queries.toArrow().to_pandas()
        partial = data.mapInPandas(_against(asked["id"].to_numpy(), _matrix(asked["vector"]).reshape(len(asked), -1), k, cosine, ties), schema) if n else data.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    else:
        blocks = _blocked(queries, QUERY_BLOCK, n).select(F.col("block").alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), F.col("rows.id").alias("query_ids"), F.col("rows.vector").alias("query_vectors"))
        rows = _blocked(data, DATA_BLOCK, data.count()).select(F.pmod("block", F.lit(SLICES)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // QUERY_BLOCK) - 1).cast("long"))).alias("query_block"), F.col("rows.id").alias("ids"), F.col("rows.vector").alias("vectors"))
        partial = rows.join(blocks, ["query_block", "slice"]).select("ids", "vectors", "query_ids", "query_vectors").mapInPandas(_block_against_block(k, cosine, ties), schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc() if ties == "low" else F.col("id").desc())
    return partial.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
