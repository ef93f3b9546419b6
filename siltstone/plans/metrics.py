"""Queries on text and model metrics, by joins of n-gram counts and by grouped means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANKS, unicode_words, words
from ..operators.ranking import positions
from ..session import table

GRAMS = 4


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prepare_openorca").select("row_id", words(F.col("response")).alias("h"), words(F.col("question")).alias("r")).filter("size(h) > 0 and size(r) > 0")


def _common_grams(rows: DataFrame, orders: range) -> DataFrame:
    """(row_id, nh, nr, m1, ...): words on either side, and the n-grams of each order that both sides hold, by their counts.

    Texts are shuffled once by row; n-grams are counted and met within a row's partition.
    """
    def grams(column: str, n: int):
        at = F.when(F.size(column) >= n, F.sequence(F.lit(1), F.size(column) - n + 1))
        return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.struct(F.lit(n).alias("order"), F.array_join(F.slice(column, i, n), " ").alias("gram"), F.lit(column).alias("side")))

    placed = rows.repartition("row_id")
    exploded = placed.select("row_id", F.size("h").alias("nh"), F.size("r").alias("nr"), F.explode(F.flatten(F.array(*[grams(c, n) for c in ("h", "r") for n in orders]))).alias("g"))
    counted = exploded.groupBy("row_id", "nh", "nr", "g.order", "g.gram").agg(F.count_if(F.col("g.side") == "h").alias("in_h"), F.count_if(F.col("g.side") == "r").alias("in_r"))
    return counted.groupBy("row_id", "nh", "nr").agg(*[F.sum(F.when(F.col("order") == n, F.least("in_h", "in_r")).otherwise(0)).alias(f"m{n}") for n in orders])


def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a response's words against its question's."""
    scored = _common_grams(_pairs(spark, sf_dir), range(1, 2))
    p, r = F.col("m1") / F.col("nh"), F.col("m1") / F.col("nr")
    return scored.select("row_id", F.round(p, 4).alias("p"), F.round(r, 4).alias("r"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-4 of a response against its question: clipped precisions, brevity penalty, zero if a precision is zero."""
    scored = _common_grams(_pairs(spark, sf_dir), range(1, GRAMS + 1))
    shares = [F.col(f"m{n}") / F.greatest(F.col("nh") - n + 1, F.lit(1)) for n in range(1, GRAMS + 1)]
    logs = sum((F.log(s) for s in shares[1:]), F.log(shares[0])) / GRAMS
    brevity = F.when(F.col("nh") >= F.col("nr"), 1.0).otherwise(F.exp(1 - F.col("nr") / F.col("nh")))
    return scored.select("row_id", F.round(F.when(F.least(*shares) > 0, brevity * F.exp(logs)).otherwise(0.0), 4).alias("bleu"))


def low_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses without ASCII words, or of twelve such words or more with too few different ones; see `weak_replies`."""
    w = words(F.col("response"))
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", w.alias("w"))
    return rows.filter((F.size("w") == 0) | (F.size("w") >= 12) & (F.size(F.array_distinct("w")) / F.size("w") < 0.38)).select("row_id", F.size("w").cast("long").alias("n_words"))


def weak_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that are blank, are at a loss, or have twelve words or more of any script with too few different ones."""
    text = F.coalesce("response", F.lit(""))
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", text.alias("t"), unicode_words(text).alias("w"))
    blank, lost = ~F.col("t").rlike(f"[^{BLANKS}]"), F.contains(F.lower("t"), F.lit("not sure how to proceed"))
    loops = (F.size("w") >= 12) & (F.size(F.array_distinct("w")) / F.size("w") < 0.38)
    return rows.filter(blank | lost | loops).select("row_id", F.size("w").cast("long").alias("n_words"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a loss-like score per source, and exp of it, capped."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("score").alias("loss"))
    return rows.select("source", F.round("loss", 6).alias("mean_loss"), F.round(F.exp(F.least("loss", F.lit(20.0))), 4).alias("perplexity"))


def tumbling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each hundred values of an event type, in order of time."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    placed = positions(rows, ["ts", "event_id"], ["event_type"])
    return placed.groupBy("event_type", F.floor((F.col("position") - 1) / 100).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def split_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows whose token estimate is within a tenth of a quarter of their characters, per corpus and source."""
    rows = table(spark, sf_dir, "split_rows").filter("estimated_tokens is not null")
    near = F.abs(F.col("estimated_tokens") - F.length("text") / 4.0) <= F.length("text") / 40.0
    return rows.groupBy("corpus", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(near.cast("double")), 6).alias("agreement"))


QUERIES = {f.__name__: f for f in (rouge1, bleu, low_quality, weak_replies, perplexity, tumbling_mean, split_agreement)}

_WORDS = "coalesce(regexp_extract_all(lower({c}), '[a-z]+'), [])"
_PAIRS = f"p AS (SELECT row_id, {_WORDS.format(c='response')} AS h, {_WORDS.format(c='question')} AS r FROM prepare_openorca), x AS (SELECT * FROM p WHERE len(h) > 0 AND len(r) > 0)"


def _gram_sql(n: int) -> str:
    side = "{c}{n} AS (SELECT row_id, gram, count(*) AS k FROM (SELECT row_id, unnest([array_to_string({c}[i : i + {m}], ' ') for i in range(1, len({c}) - {m} + 1)]) AS gram FROM x) GROUP BY ALL)"
    return ", ".join(side.format(c=c, n=n, m=n - 1) for c in ("h", "r")) + f", m{n} AS (SELECT h.row_id, sum(least(h.k, r.k)) AS m{n} FROM h{n} h JOIN r{n} r ON h.row_id = r.row_id AND h.gram = r.gram GROUP BY ALL)"


ORACLES = {
    "rouge1": f"WITH {_PAIRS}, {_gram_sql(1)}, s AS (SELECT x.row_id, coalesce(m1, 0) / len(h) AS p, coalesce(m1, 0) / len(r) AS r FROM x LEFT JOIN m1 ON x.row_id = m1.row_id) SELECT row_id, round(p, 4) AS p, round(r, 4) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM s",
    "bleu": f"WITH {_PAIRS}, {', '.join(_gram_sql(n) for n in range(1, 5))}, s AS (SELECT x.row_id, len(h) AS nh, len(r) AS nr, coalesce(m1, 0) / greatest(len(h), 1) AS s1, coalesce(m2, 0) / greatest(len(h) - 1, 1) AS s2, coalesce(m3, 0) / greatest(len(h) - 2, 1) AS s3, coalesce(m4, 0) / greatest(len(h) - 3, 1) AS s4 FROM x LEFT JOIN m1 USING (row_id) LEFT JOIN m2 USING (row_id) LEFT JOIN m3 USING (row_id) LEFT JOIN m4 USING (row_id)) SELECT row_id, round(CASE WHEN least(s1, s2, s3, s4) > 0 THEN (CASE WHEN nh >= nr THEN 1.0 ELSE exp(1 - nr / nh) END) * exp((ln(s1) + ln(s2) + ln(s3) + ln(s4)) / 4) ELSE 0 END, 4) AS bleu FROM s",
    "low_quality": f"WITH r AS (SELECT row_id, {_WORDS.format(c='response')} AS w FROM prepare_openorca) SELECT row_id, len(w) AS n_words FROM r WHERE len(w) = 0 OR (len(w) >= 12 AND len(list_distinct(w)) / len(w) < 0.38)",
    "weak_replies": r"WITH r AS (SELECT row_id, coalesce(response, '') AS t, coalesce(regexp_extract_all(lower(coalesce(response, '')), '[\p{L}\p{N}_]+'), []) AS w FROM prepare_openorca) SELECT row_id, len(w) AS n_words FROM r WHERE NOT regexp_matches(t, '[^\s\x0B\x1C-\x1F\x{85}\pZ]') OR contains(lower(t), 'not sure how to proceed') OR (len(w) >= 12 AND len(list_distinct(w)) / len(w) < 0.38)",
    "perplexity": "SELECT source, round(avg(score), 6) AS mean_loss, round(exp(least(avg(score), 20.0)), 4) AS perplexity FROM documents GROUP BY source",
    "tumbling_mean": "WITH r AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS step FROM events) SELECT event_type, step, count(*) AS n, round(avg(value), 6) AS mean_value FROM r GROUP BY ALL",
    "split_agreement": "SELECT corpus, source, count(*) AS n, round(avg(CASE WHEN abs(estimated_tokens - length(text) / 4.0) <= length(text) / 40.0 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM split_rows WHERE estimated_tokens IS NOT NULL GROUP BY corpus, source",
}
