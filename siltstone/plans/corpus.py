"""Queries on corpus preparation: cleaning, filtering, splitting, quotas, budgets, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cut_at_sentence, estimate_tokens, hash_bucket, normalize, short_id
from ..operators.ranking import positions
from ..session import table

VALIDATION = 200  # of 10,000 hash buckets
KEYWORDS = ("vibration", "leakage", "overheating", "pressure drop", "corrosion", "vibración", "leckage", "fuite")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return raw.withColumn("line", normalize(F.col("raw")))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _lines(spark, sf_dir).filter(F.length("line").between(8, 500))
    return kept.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("raw_lines"), F.count_if(F.col("line") != "").alias("clean_lines"), F.count_if(F.length("line").between(8, 500)).alias("kept_lines"))


def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("text")).filter(F.length("text") >= 200)
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), estimate_tokens(F.col("text")).alias("estimated_tokens"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(hash_bucket(F.col("text")) < VALIDATION, "val").otherwise("train").alias("split"))


def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("val", hash_bucket(F.col("text")) < VALIDATION).withColumn("skipped", F.length("text") < 100)
    return rows.groupBy("source").agg(F.count_if(~F.col("val") & ~F.col("skipped")).alias("train"), F.count_if(F.col("val") & ~F.col("skipped")).alias("val"), F.count_if("skipped").alias("skipped"))


def head_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each source are held out: at least one, and a fiftieth."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    placed = positions(rows, ["doc_id"], ["source"])
    sizes = rows.groupBy("source").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 0.02)).alias("held"))
    return placed.join(sizes, "source").select("doc_id", F.when(F.col("position") <= F.col("held"), "val").otherwise("train").alias("split"))


def every_nth_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter(F.length("text") >= 200).select("doc_id")
    return positions(rows, ["doc_id"]).select("doc_id", F.when(F.col("position") % 50 == 0, "val").otherwise("train").alias("split"))


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order until the running total of tokens reaches half of all: the one that crosses it is the last."""
    rows = table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(normalize(F.col("text"))).alias("tokens"))
    half = rows.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) / 2).alias("half")).first()["half"]
    placed = positions(rows, ["doc_id"], running={"total": F.col("tokens")})
    return placed.filter(F.col("total") - F.col("tokens") < half).select("doc_id", "tokens", F.col("total").cast("long").alias("running_tokens"))


def weighted_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of the blend's sources merged by quota: at each step the source that is furthest behind gives a row.

    The greedy merge has a closed form: row k of a source with quota q comes at k / q, ties in order of the sources.
    """
    targets = table(spark, sf_dir, "blend_targets").select("source", "requested_rows").filter("requested_rows > 0")
    training = F.lower(F.trim("split")).isin("train", "pretrain")  # a corpus may call its training split either
    rows = table(spark, sf_dir, "split_rows").filter(training).select("row_id", "source").join(targets, "source")
    kept = positions(rows, ["row_id"], ["source"]).filter(F.col("position") <= F.col("requested_rows"))
    due = kept.select("source", "row_id", ((F.col("position") - 1) / F.col("requested_rows")).alias("due"))
    return positions(due, ["due", "source", "row_id"]).select("source", "row_id", "position")


def row_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of a total by weight, rounded down; the remainder goes to the first source."""
    targets = table(spark, sf_dir, "blend_targets").filter("weight > 0")
    whole = targets.agg(F.sum("requested_rows").alias("total"), F.sum("weight").alias("weights"), F.min("source").alias("first")).first()
    if whole["total"] is None:
        return targets.select("source", F.lit(0).cast("long").alias("quota"))
    quota = F.floor(F.lit(whole["total"]) * F.col("weight") / F.lit(whole["weights"]) + 1e-9)
    given = targets.agg(F.sum(quota).alias("given")).first()["given"]
    return targets.select("source", (quota + F.when(F.col("source") == whole["first"], whole["total"] - given).otherwise(0)).cast("long").alias("quota"))


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.lower("text").rlike("|".join(KEYWORDS))).select("doc_id", "source")


def truncate_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_at_sentence(normalize(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("cut")).filter(F.length("cut") >= 100).select("doc_id", F.length("cut").cast("long").alias("n_chars"), F.md5("cut").alias("cut_md5"))


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    document_id = short_id(F.coalesce("source_path", F.lit("")), F.col("doc_id").cast("string"), F.substring("text", 1, 256))
    return rows.select("doc_id", document_id.alias("document_id"), F.sha2("text", 256).alias("content_sha256"))


def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "messages").select("id", "conversation_id", F.lower(F.trim("role")).alias("role"), normalize(F.col("content")).alias("content"))
    kept = rows.filter((F.col("content") != "") & (F.coalesce("role", F.lit("")) != ""))
    return kept.select("id", "conversation_id", F.concat(F.lit("<|"), "role", F.lit("|> "), "content").alias("rendered"))


def qa_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", *[normalize(F.col(c)).alias(c) for c in ("system", "question", "response")])
    kept = rows.filter("question != '' and response != ''")
    system = F.when(F.col("system") == "", "You are a helpful assistant.").otherwise(F.col("system"))
    prompt = F.concat(F.lit("<|system|> "), F.left(system, F.lit(512)), F.lit(" <|user|> "), F.left("question", F.lit(512)), F.lit(" <|assistant|> "), F.left("response", F.lit(1024)))
    return kept.select("row_id", F.concat_ws("\n", "question", "response").alias("pretrain_text"), prompt.alias("instruct_text"))


def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row as `column: value | column: value`, without empty values."""
    part = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in ("corpus", "source", "split", "estimated_tokens")]
    return table(spark, sf_dir, "split_rows").select("row_id", F.concat_ws(" | ", *part).alias("row_text"))


QUERIES = {f.__name__: f for f in (clean_lines, stage_counts, normalized_tokens, hash_split, split_stats, head_split, every_nth_split, token_budget, weighted_interleave, row_quota, keyword_filter, truncate_sentence, content_ids, chat_render, qa_format, row_text)}

_NORM = r"trim(regexp_replace(coalesce({c}, ''), '[\s\pZ]+', ' ', 'g'))"
_LINES = "SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, " + r"trim(regexp_replace(unnest(string_split(text, chr(10))), '[\s\pZ]+', ' ', 'g')) AS line FROM documents"
_TOKENS = "CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length({t}) / 4.0) AS BIGINT)) END"
_BUCKET = "(CAST(('0x' || substr(sha256(coalesce(text, '')), 1, 8)) AS BIGINT) % 10000)"

ORACLES = {
    "clean_lines": f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM ({_LINES}) WHERE length(line) BETWEEN 8 AND 500",
    "stage_counts": f"SELECT source, count(*) AS raw_lines, count(*) FILTER (line <> '') AS clean_lines, count(*) FILTER (length(line) BETWEEN 8 AND 500) AS kept_lines FROM ({_LINES}) GROUP BY source",
    "normalized_tokens": f"WITH n AS (SELECT doc_id, {_NORM.format(c='text')} AS t FROM documents) SELECT doc_id, length(t) AS n_chars, CAST({_TOKENS.format(t='t')} AS BIGINT) AS estimated_tokens FROM n WHERE length(t) >= 200",
    "hash_split": f"SELECT doc_id, CASE WHEN {_BUCKET} < {VALIDATION} THEN 'val' ELSE 'train' END AS split FROM documents",
    "split_stats": f"WITH r AS (SELECT source, {_BUCKET} < {VALIDATION} AS val, length(text) < 100 AS skipped FROM documents) SELECT source, count(*) FILTER (NOT val AND NOT skipped) AS train, count(*) FILTER (val AND NOT skipped) AS val, count(*) FILTER (skipped) AS skipped FROM r GROUP BY source",
    "head_split": "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, CASE WHEN k <= greatest(1, floor(n * 0.02)) THEN 'val' ELSE 'train' END AS split FROM r",
    "every_nth_split": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 200) SELECT doc_id, CASE WHEN k % 50 = 0 THEN 'val' ELSE 'train' END AS split FROM r",
    "token_budget": f"WITH n AS (SELECT doc_id, {_NORM.format(c='text')} AS t FROM documents), k AS (SELECT doc_id, CAST({_TOKENS.format(t='t')} AS BIGINT) AS tokens FROM n), r AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY doc_id) AS BIGINT) AS running_tokens FROM k) SELECT * FROM r WHERE running_tokens - tokens < (SELECT floor(sum(tokens) / 2) FROM k)",
    "weighted_interleave": "WITH r AS (SELECT s.source, row_id, requested_rows AS q, row_number() OVER (PARTITION BY s.source ORDER BY row_id) AS k FROM split_rows s JOIN blend_targets t ON s.source = t.source WHERE lower(trim(split)) IN ('train', 'pretrain') AND requested_rows > 0) SELECT source, row_id, row_number() OVER (ORDER BY CAST(k - 1 AS DOUBLE) / q, source, row_id) AS position FROM r WHERE k <= q",
    "row_quota": "WITH t AS (SELECT source, CAST(floor((SELECT sum(requested_rows) FROM blend_targets WHERE weight > 0) * weight / (SELECT sum(weight) FROM blend_targets WHERE weight > 0) + 1e-9) AS BIGINT) AS q FROM blend_targets WHERE weight > 0) SELECT source, CAST(q + CASE WHEN source = (SELECT min(source) FROM t) THEN (SELECT sum(requested_rows) FROM blend_targets WHERE weight > 0) - (SELECT sum(q) FROM t) ELSE 0 END AS BIGINT) AS quota FROM t",
    "keyword_filter": f"SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '{'|'.join(KEYWORDS)}')",
    "truncate_sentence": rf"WITH n AS (SELECT doc_id, {_NORM.format(c='text')} AS t FROM documents), h AS (SELECT doc_id, t, substr(t, 1, 2000) AS head FROM n), s AS (SELECT *, CASE WHEN contains(head, '.') THEN length(head) - instr(reverse(head), '.') + 1 ELSE 0 END AS stop FROM h), c AS (SELECT doc_id, CASE WHEN length(t) <= 2000 THEN t WHEN stop - 1 > 500 THEN substr(head, 1, stop) ELSE head END AS cut FROM s) SELECT doc_id, length(cut) AS n_chars, md5(cut) AS cut_md5 FROM c WHERE length(cut) >= 100",
    "content_ids": "SELECT doc_id, substr(sha256(concat_ws(':', coalesce(source_path, ''), CAST(doc_id AS VARCHAR), substr(text, 1, 256))), 1, 24) AS document_id, sha256(text) AS content_sha256 FROM documents",
    "chat_render": f"WITH r AS (SELECT id, conversation_id, lower(trim(role)) AS role, {_NORM.format(c='content')} AS content FROM messages) SELECT id, conversation_id, '<|' || role || '|> ' || content AS rendered FROM r WHERE content <> '' AND coalesce(role, '') <> ''",
    "qa_format": f"WITH r AS (SELECT row_id, {_NORM.format(c='system')} AS s, {_NORM.format(c='question')} AS q, {_NORM.format(c='response')} AS a FROM prepare_openorca) SELECT row_id, q || chr(10) || a AS pretrain_text, '<|system|> ' || substr(CASE WHEN s = '' THEN 'You are a helpful assistant.' ELSE s END, 1, 512) || ' <|user|> ' || substr(q, 1, 512) || ' <|assistant|> ' || substr(a, 1, 1024) AS instruct_text FROM r WHERE q <> '' AND a <> ''",
    "row_text": "SELECT row_id, concat_ws(' | ', CASE WHEN corpus <> '' THEN 'corpus: ' || corpus END, CASE WHEN source <> '' THEN 'source: ' || source END, CASE WHEN split <> '' THEN 'split: ' || split END, CASE WHEN estimated_tokens IS NOT NULL THEN 'estimated_tokens: ' || CAST(estimated_tokens AS VARCHAR) END) AS row_text FROM split_rows",
}
