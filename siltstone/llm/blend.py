"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's rows are its training rows (split train or pretrain). Each source is due its weight of the sum of requested_rows.
A source that would need more than max_repeats passes over its rows is clamped there, and what it can't give is shared among
the others in proportion to their weights, until nothing changes. In order of rows that can be had for a unit of weight, the
clamped sources are those that the level, with all sources before them clamped, still overflows; running totals over that
order find them in one pass, however many sources there are. A source's rows are then used `whole` times each, and the rest
once more, the rows of lowest seeded hash first.

Positions within a source come from a range sort over (source, hash) and the sizes of its pieces, so a source with a third
of all rows spreads over many tasks.

Defined results: rows whose source is null or has no target are not used; weights are taken relative to their sum; a null,
NaN or negative weight is zero, a null max_repeats one; a source without rows reaches zero, its share goes to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions
from ..session import stage

SEED = 20240


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """(source, used) from sources (source, weight, cap): whole rows within the caps, in proportion to the weights, their sum
    total where the caps allow it. Only sums reach the driver."""
    usable = sources.filter("weight > 0 and cap > 0").withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("falling", -F.col("ratio"))
    placed = positions(usable, ["falling", "source"], running={"caps": F.col("cap"), "weights": F.col("weight")})  # of this source and those after it
    all_caps = usable.agg(F.sum("cap").alias("c")).first()["c"] or 0
    level = (F.lit(float(total)) - (F.lit(all_caps) - F.col("caps"))) / F.col("weights")
    placed = stage(placed.withColumn("clamped", level >= F.col("ratio")).select("source", "weight", "cap", "clamped"), "levels")
    sums = placed.agg(F.sum(F.when(F.col("clamped"), F.col("cap"))).alias("cap"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("weight")).first()
    level = max(0.0, (total - (sums["cap"] or 0)) / sums["weight"]) if sums["weight"] else 0.0
    due = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * level))
    due = placed.select("source", "cap", due.alias("due")).withColumn("rows", F.floor(F.col("due") + 1e-9).cast("long"))
    short = due.agg((F.round(F.sum("due")) - F.sum("rows")).alias("n")).first()["n"] or 0
    ranked = positions(due.withColumn("rest", F.col("rows") - F.col("due")), ["rest", "source"])
    return ranked.select("source", F.least("cap", F.col("rows") + (F.col("position") <= int(short)).cast("long")).alias("used"))


def training_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.lower(F.trim("split")).isin("train", "pretrain") & F.col("source").isNotNull()).select("row_id", "source")


def blend_plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target: available rows, due rows, the whole passes over a source and the rows used once more."""
    weight = F.greatest(F.nanvl(F.coalesce(F.max("weight"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    due = targets.select("source", "weight", "requested_rows", "max_repeats").filter("source is not null").groupBy("source").agg(weight.alias("weight"), F.coalesce(F.max("requested_rows"), F.lit(0)).alias("requested_rows"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    have = training_rows(rows).groupBy("source").agg(F.count(F.lit(1)).alias("have"))
    plan = stage(due.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0))), "plan")
    sums = plan.agg(F.sum("requested_rows").alias("total"), F.sum("weight").alias("weight")).first()
    total, all_weights = sums["total"] or 0, sums["weight"] or 1.0
    used = water_fill(plan.select("source", "weight", (F.col("have") * F.col("max_repeats")).alias("cap")), float(total))
    share = F.col("weight") / all_weights
    found = plan.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    once, more = F.floor(F.col("used") / F.greatest("have", F.lit(1))), F.col("used") % F.greatest("have", F.lit(1))
    found = found.select("source", F.round(share, 6).alias("target_share"), F.round(share * total, 6).alias("target_rows"), F.col("have").alias("available_rows"), "max_repeats", F.col("used").alias("reached_rows"), once.cast("long").alias("whole"), more.alias("once_more"))
    return stage(found, "plan")


def _used(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    hashed = training_rows(rows).join(plan.select("source", "whole", "once_more"), "source").withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "source", "row_id")))
    ranked = positions(hashed, ["h", "row_id"], ["source"])
    uses = F.col("whole") + (F.col("position") <= F.col("once_more")).cast("long")
    return ranked.select("source", "row_id", uses.alias("uses")).filter("uses > 0")


def blend(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, row_id, copy): the blend, a row for each use of a training row."""
    used = _used(rows, blend_plan(rows, targets), seed)
    return used.select("source", "row_id", F.explode(F.sequence(F.lit(1).cast("long"), "uses")).alias("copy"))


def blend_shares(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """What each source was due and what it really reached, counted over the blend itself."""
    plan = blend_plan(rows, targets)
    reached = stage(_used(rows, plan, seed).groupBy("source").agg(F.sum("uses").alias("reached"), F.count(F.lit(1)).alias("distinct_rows"), F.max("uses").alias("most_uses")), "reached")
    everything = reached.agg(F.sum("reached").alias("n")).first()["n"] or 0
    found = plan.drop("whole", "once_more", "reached_rows").join(reached, "source", "left").na.fill(0, ["reached", "distinct_rows", "most_uses"])
    return found.select("source", "target_share", "target_rows", "available_rows", "max_repeats", "distinct_rows", "most_uses", F.col("reached").alias("reached_rows"), F.round(F.col("reached") / max(1, everything), 6).alias("reached_share"))
