"""Rebuilding ordered conversations from message rows, and naming those that are unusable.

Messages equal in conversation, cleaned role, content and instant are one message (the lowest id). Senders' clocks may be off.
For each conversation the clock offsets of its senders are the least-squares solution (smallest sum of squares) under its
reply-before constraints, of two kinds:

* A message that names in its metadata the one it answers (reply_to) must not come before it. Such an offset may change the
  order; constraints that no offsets can meet make the conversation broken.
* Work on an answer that follows a user's message, begun latency_ms before it was sent, must not have begun before that
  message. Latencies are figures of the computation and may be wrong, so they move clocks only as far as every two
  neighbouring turns keep their order; a latency that asks for more than that is taken for a wrong figure and moves nothing.
  These offsets correct instants and leave the order by instant, then id, as it is.

Turns are merged by a range sort over (conversation, corrected instant, id), so a conversation with a third of all messages
spreads over many tasks; what a conversation lacks is found inside each piece and at the seams between pieces.

Defined results: rows with a null conversation_id belong to no conversation; an instant that can't be read sorts last, by id;
null content is blank; a missing offset means UTC; of copies of a message the least latency counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, stage

SENDERS = ("user", "assistant", "system", "tool")
SWEEPS = 500


def clean_role(c: Column) -> Column:
    role = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}\p{C}]+", ""))
    return F.when(role == "human", "user").when(role.isin("gpt", "bot"), "assistant").otherwise(role)


def instant_of(c: Column) -> Column:
    """ISO spellings with blank or T, fractions, Z or an offset with or without colon; without an offset UTC."""
    text = F.regexp_replace(F.trim(c), r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(text.rlike(r"(?i)(z|[+-]\d{2}(:\d{2})?)$") & text.rlike(r":\d{2}"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def is_visible(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[^\s\p{Z}\p{C}⠀ㅤ]"), F.lit(False))


def least_offsets(bounds: list[tuple[int, int, float]]) -> tuple[np.ndarray, bool]:
    """Offsets o of least sum of squares with o[i] - o[j] >= bound, and whether there are any (Dykstra's projections)."""
    far = np.full((len(SENDERS), len(SENDERS)), -np.inf)
    for i, j, b in bounds:
        far[i, j] = max(far[i, j], b)
    reach = far.copy()
    for k in range(len(SENDERS)):
        reach = np.maximum(reach, reach[:, k, None] + reach[None, k, :])
    if (np.diag(reach) > 1e-9).any():  # a circle of constraints that asks for more time than there is
        return np.zeros(len(SENDERS)), False
    rules = [(i, j, far[i, j]) for i in range(len(SENDERS)) for j in range(len(SENDERS)) if i != j and np.isfinite(far[i, j])]
    o, due = np.zeros(len(SENDERS)), np.zeros(len(rules))
    for _ in range(SWEEPS):
        before = o.copy()
        for r, (i, j, b) in enumerate(rules):
            step = max(-due[r], (b - (o[i] - o[j])) / 2)
            due[r] += step
            o[i] += step
            o[j] -= step
        if np.abs(o - before).max() < 1e-9:
            break
    return o, True


def _offsets(bounds: pd.Series) -> pd.DataFrame:
    solved = [least_offsets([(int(b["i"]), int(b["j"]), float(b["bound"])) for b in rows]) for rows in bounds]
    return pd.DataFrame({"offsets": [list(map(float, o)) for o, _ in solved], "feasible": [f for _, f in solved]})


def clean_messages(messages: DataFrame) -> DataFrame:
    """One row for each distinct message, with its cleaned role and its instant in microseconds."""
    told = F.from_json("metadata", "reply_to string, latency_ms string")
    rows = messages.select("id", "conversation_id", clean_role(F.col("role")).alias("role"), "content", instant_of(F.col("created_at")).alias("instant"), told.alias("told"))
    rows = rows.select("id", "conversation_id", "role", "content", "instant", F.col("told.reply_to").try_cast("long").alias("reply_to"), F.col("told.latency_ms").try_cast("double").alias("latency_ms"))
    rows = rows.filter("conversation_id is not null").groupBy("conversation_id", "role", "content", "instant").agg(F.min("id").alias("id"), F.min("reply_to").alias("reply_to"), F.min("latency_ms").alias("latency_ms"))
    return rows.withColumn("at", F.unix_micros("instant"))


def _sender(role: str = "role") -> Column:
    return F.array_position(F.array(*map(F.lit, SENDERS)), F.col(role)) - 1


def _solved(bounds: DataFrame) -> DataFrame:
    """(conversation_id, offsets, feasible) from (conversation_id, i, j, bound): at most a row for each two senders."""
    lists = bounds.groupBy("conversation_id").agg(F.collect_list(F.struct("i", "j", "bound")).alias("bounds"))
    solve = F.pandas_udf(_offsets, "offsets array<double>, feasible boolean")
    return lists.select("conversation_id", solve("bounds").alias("s")).select("conversation_id", "s.offsets", "s.feasible")


def reply_offsets(rows: DataFrame) -> DataFrame:
    """(conversation_id, offsets, feasible) for conversations with messages that come before what they say they answer."""
    links = rows.filter("reply_to is not null").select("conversation_id", F.col("reply_to").alias("id"), _sender().alias("i"), F.col("at").alias("answered"))
    asked = rows.select("conversation_id", "id", _sender().alias("j"), F.col("at").alias("asked"))
    pairs = links.join(asked, ["conversation_id", "id"]).filter("i >= 0 and j >= 0 and i != j")
    bounds = pairs.groupBy("conversation_id", "i", "j").agg((F.max(F.col("asked") - F.col("answered")) / 1e6).alias("bound"))
    late = bounds.groupBy("conversation_id").agg(F.max("bound").alias("most")).filter("most > 0").select("conversation_id")
    return _solved(bounds.join(late, "conversation_id", "left_semi"))


def latency_offsets(turns: DataFrame) -> DataFrame:
    """(conversation_id, offsets): clock offsets in seconds, by sender, of conversations with answers sooner than their latency."""
    inside = Window.partitionBy("conversation_id", "piece").orderBy("at", "id")
    rows = turns.withColumn("j", _sender()).filter("j >= 0 and not late").select("conversation_id", "piece", "at", "id", "j", "latency_ms")
    rows = rows.withColumns({"i": F.lag("j").over(inside), "was": F.lag("at").over(inside)})
    place = F.struct("at", "id")
    pieces = rows.groupBy("conversation_id", "piece").agg(F.min_by(F.struct("j", "at", "latency_ms"), place).alias("first"), F.max_by(F.struct("j", "at"), place).alias("last"))
    seams = pieces.withColumn("before", F.lag("last").over(Window.partitionBy("conversation_id").orderBy("piece"))).filter("before is not null")
    seams = seams.select("conversation_id", F.col("first.j").alias("j"), F.col("first.at").alias("at"), F.col("first.latency_ms").alias("latency_ms"), F.col("before.j").alias("i"), F.col("before.at").alias("was"))
    steps = rows.filter("i is not null").select(*seams.columns).unionByName(seams).filter("i != j")
    answers = (F.col("i") == SENDERS.index("user")) & (F.col("j") == SENDERS.index("assistant"))
    least = F.col("was") - F.col("at") + F.when(answers & (F.col("latency_ms") > 0), F.col("latency_ms") * 1000).otherwise(0)
    bounds = steps.groupBy("conversation_id", F.col("j").alias("i"), F.col("i").alias("j")).agg((F.max(least) / 1e6).alias("bound"))
    early = bounds.filter("bound > 0").select("conversation_id").distinct()
    return _solved(bounds.join(early, "conversation_id", "left_semi")).filter("feasible").select("conversation_id", "offsets")


def ordered_messages(messages: DataFrame) -> DataFrame:
    """The distinct messages in range-sorted pieces: piece numbers grow with (conversation, corrected instant, id)."""
    rows = stage(clean_messages(messages), "messages")
    if rows.filter("reply_to is not null").isEmpty():
        rows = rows.withColumns({"shift_s": F.lit(0.0), "infeasible": F.lit(False)})
    else:
        rows = rows.join(reply_offsets(rows), "conversation_id", "left").withColumns({"shift_s": _shift("offsets"), "infeasible": ~F.coalesce("feasible", F.lit(True))})
    rows = rows.withColumn("at", F.col("at") + F.round(F.col("shift_s") * 1e6).cast("long")).withColumn("late", F.col("at").isNull())
    order = ["conversation_id", "late", "at", "id"]
    n = max(1, partitions(rows.sparkSession))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id())
    return stage(ranged.select("conversation_id", "piece", "late", "at", "id", "role", "content", "instant", "latency_ms", "shift_s", "infeasible", is_visible(F.col("content")).alias("visible")), "turns")


def _shift(offsets: str) -> Column:
    """The offset of the row's sender in seconds; senders of other roles have none."""
    place = _sender() + 1
    return F.when(place > 0, F.coalesce(F.try_element_at(offsets, place.cast("int")), F.lit(0.0))).otherwise(0.0)


def sender_offsets(messages: DataFrame) -> DataFrame:
    """(conversation_id, role, offset_s): the clock offsets that are not zero."""
    turns = ordered_messages(messages)
    known = turns.join(latency_offsets(turns), "conversation_id", "left").select("conversation_id", "role", (F.col("shift_s") + _shift("offsets")).alias("offset_s"))
    return known.filter("abs(offset_s) > 1e-9").groupBy("conversation_id", "role").agg(F.max("offset_s").alias("offset_s"))


def conversation_defects(turns: DataFrame) -> DataFrame:
    """(conversation_id, defect, turns): defect is null for a usable conversation."""
    inside = Window.partitionBy("conversation_id", "piece").orderBy("late", "at", "id")
    talks = F.col("visible") & F.col("role").isin("user", "assistant")
    talk = turns.filter(talks).withColumn("before", F.lag("role").over(inside)).withColumn("place", F.struct("late", F.coalesce("at", F.lit(0)).alias("at"), "id"))
    pieces = talk.groupBy("conversation_id", "piece").agg(
        F.min_by("role", "place").alias("first"), F.max_by("role", "place").alias("last"),
        F.max((F.col("role") == "assistant") & (F.col("before") == "assistant")).alias("twice"), F.max((F.col("role") == "user") & (F.col("before") == "user")).alias("unanswered"),
    )
    seams = Window.partitionBy("conversation_id").orderBy("piece")
    pieces = pieces.withColumn("before", F.lag("last").over(seams)).withColumn("after", F.lead("first").over(seams))
    opening = (F.col("first") == "assistant") & (F.col("before").isNull() | (F.col("before") == "assistant"))
    open_end = (F.col("last") == "user") & (F.col("after").isNull() | (F.col("after") == "user"))
    spoken = pieces.groupBy("conversation_id").agg(F.max(F.coalesce("twice", F.lit(False)) | opening).alias("broken"), F.max(F.coalesce("unanswered", F.lit(False)) | open_end).alias("missing"))
    whole = turns.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("turns"), F.max(~F.col("role").isin(*SENDERS) | F.col("infeasible")).alias("strange"), F.max(talks).alias("spoken"))
    found = whole.join(spoken, "conversation_id", "left")
    defect = F.when(~F.col("spoken"), "empty").when(F.col("strange") | F.col("broken"), "broken").when(F.col("missing"), "missing_reply")
    return found.select("conversation_id", defect.alias("defect"), "turns")


def conversations(messages: DataFrame) -> DataFrame:
    """The turns of the usable conversations: (conversation_id, turn, role, content, instant, corrected)."""
    turns = ordered_messages(messages)
    usable = conversation_defects(turns).filter("defect is null").select("conversation_id")
    inside = Window.partitionBy("conversation_id", "piece").orderBy("late", "at", "id")
    seams = Window.partitionBy("conversation_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conversation_id", "piece").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(seams), F.lit(0))).drop("n")
    numbered = turns.withColumn("place", F.row_number().over(inside)).join(sizes, ["conversation_id", "piece"])
    numbered = numbered.join(usable, "conversation_id", "left_semi").join(latency_offsets(turns), "conversation_id", "left")
    corrected = F.timestamp_micros(F.unix_micros("instant") + F.round((F.col("shift_s") + _shift("offsets")) * 1e6).cast("long"))
    return numbered.select("conversation_id", (F.col("before") + F.col("place")).cast("long").alias("turn"), "role", "content", "instant", corrected.alias("corrected"))
