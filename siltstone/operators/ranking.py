"""Exact positions and running totals over an order, without sending a whole group through one task.

Rows are range-sorted over (keys, order) into pieces; a row's position is its place within its piece plus the sizes of the
pieces before it. A key with a third of all rows is cut into as many pieces as its share of the data asks for.

Defined results: an empty table gives no rows; nulls in a running column count as zero; a column named position, or as a
running total, is replaced; the other columns keep their names,
and names that begin with an underscore followed by r_, t_, k_, b_ or s_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, stage


def positions(df: DataFrame, order: list, keys: list[str] = (), running: dict[str, Column] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """Adds `position` (from 1, within keys), a running total, this row included, for each entry of `running`, and the least
    value of all rows before this one for each entry of `least` (null on the first).

    `order` must be a total order within the keys. Rows with a null key form groups of their own.
    """
    running, least = running or {}, least or {}
    keys = list(keys)
    flagged = df.withColumns({f"_r_{n}": c for n, c in (running | least).items()})
    ranged = stage(flagged.repartitionByRange(max(1, partitions(df.sparkSession)), *keys, *order).withColumn("_piece", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_r_{n}").alias(f"_s_{n}") for n in running], *[F.min(f"_r_{n}").alias(f"_s_{n}") for n in least])
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in running], *[F.min(f"_s_{n}").over(before).alias(f"_b_{n}") for n in least])
    same = F.col("_piece") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = ranged.withColumns({"_place": F.row_number().over(inside), **{f"_t_{n}": F.coalesce(F.sum(f"_r_{n}").over(inside), F.lit(0)) for n in running}, **{f"_t_{n}": F.min(f"_r_{n}").over(earlier) for n in least}})
    found = placed.join(sizes, same).withColumns({"position": (F.col("_place") + F.col("_before")).cast("long"), **{n: F.col(f"_t_{n}") + F.col(f"_b_{n}") for n in running}, **{n: F.least(f"_t_{n}", f"_b_{n}") for n in least}})
    added = [*running, *least]
    return found.select(*[c for c in df.columns if c not in added and c != "position"], "position", *added)
