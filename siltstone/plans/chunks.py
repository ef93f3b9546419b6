"""Queries on chunks, shards, pre-tokens and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pieces
from ..operators import chunking
from ..operators.ranking import positions
from ..session import stage, table

SHARD_ROWS = 500
WINDOW, STRIDE = 64, 32


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_chunks(table(spark, sf_dir, "documents"))


def knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.knowledge_chunks(table(spark, sf_dir, "documents"))


def shard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and byte offset of each vector in a raw file of 32-bit floats, SHARD_ROWS to a shard."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"))
    at = F.col("position") - 1
    return positions(rows, ["vec_id"]).select("vec_id", F.floor(at / SHARD_ROWS).cast("long").alias("shard"), ((at % SHARD_ROWS) * F.col("dim") * 4).cast("long").alias("byte_offset"))


def pretoken_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(pieces(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def pair_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring characters of pre-tokens, weighted by the pre-tokens' frequency."""
    counted = pretoken_freq(spark, sf_dir).filter(F.length("piece") > 1)
    at = counted.select("piece", "n", F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("i"))
    return at.select(F.substring("piece", F.col("i"), F.lit(2)).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows within each document: inputs, and targets one further; `corpus_windows` loses no document's tail."""
    rows = table(spark, sf_dir, "documents").select("doc_id", pieces(F.col("text")).alias("tokens")).filter(F.size("tokens") > WINDOW)
    starts = rows.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - WINDOW - 1, F.lit(STRIDE))).alias("start"))
    window = F.slice("tokens", F.col("start") + 1, WINDOW)
    following = F.slice("tokens", F.col("start") + 2, WINDOW)
    return starts.select("doc_id", F.col("start").cast("long").alias("start"), F.md5(F.array_join(window, "\x1f")).alias("input_md5"), F.md5(F.array_join(following, "\x1f")).alias("target_md5"))


def stream_windows(texts: DataFrame, key: str, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Sliding windows over the pre-tokens of all texts in order of key, as one stream; only the stream's own tail is in none.

    A stream too short for a window is repeated ceil((window + 2) / length) times. A text's pre-tokens are first gathered by
    window within the text; parts of a window meet by its start, so no group is larger than a window.
    """
    rows = texts.select(key, pieces(F.col("text")).alias("tokens")).filter("size(tokens) > 0")
    placed = positions(rows, [key], running={"end": F.size("tokens").cast("long")}).select((F.col("end") - F.size("tokens")).alias("at"), "tokens")
    placed = stage(placed, "placed")
    total = placed.agg(F.sum(F.size("tokens"))).first()[0] or 0
    if 0 < total <= window:
        repeats = -(-(window + 2) // total)
        again = placed.select("at", "tokens", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"))
        placed = again.select((F.col("at") + F.col("turn") * total).cast("long").alias("at"), "tokens")
        total *= repeats
    if total <= window:
        return placed.select(F.col("at").alias("start"), F.lit("").alias("input_md5"), F.lit("").alias("target_md5")).limit(0)
    last = (total - window - 1) // stride
    n = F.size("tokens")
    first = F.greatest(F.lit(0), F.floor((F.col("at") - window + stride - 1) / stride))
    numbers = F.sequence(first.cast("long"), F.least(F.lit(last), F.floor((F.col("at") + n - 1) / stride)).cast("long"))
    parts = placed.filter(first <= last).select("at", "tokens", F.explode(numbers).alias("number")).withColumn("start", F.col("number") * stride)
    begin = F.greatest(F.lit(0), F.col("start") - F.col("at")).cast("int")
    end = F.least(n, F.col("start") + window + 1 - F.col("at")).cast("int")
    parts = parts.select("start", "at", F.slice("tokens", begin + 1, end - begin).alias("part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]))
    windows = parts.groupBy("start").agg(whole.alias("tokens"))
    return windows.select("start", F.md5(F.array_join(F.slice("tokens", 1, window), "\x1f")).alias("input_md5"), F.md5(F.array_join(F.slice("tokens", 2, window), "\x1f")).alias("target_md5"))


def corpus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows over the pre-tokens of the whole corpus, documents in order of id."""
    return stream_windows(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {f.__name__: f for f in (fixed_chunks, sentence_chunks, knowledge_chunks, shard_layout, pretoken_freq, pair_freq, token_windows, corpus_windows)}

_PIECES = r"regexp_extract_all(text, ' ?[\p{L}\p{N}_]+| ?[^\sA-Za-z0-9_]+|\s+')"
_STRIP = r"regexp_replace(substr(t, st + 1, en - st), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
_NUMBERED = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS chunk_no, CAST(st AS BIGINT) AS char_start, CAST(en AS BIGINT) AS char_end, {_STRIP} AS chunk FROM c WHERE {_STRIP} <> ''"

ORACLES = {
    "fixed_chunks": "WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 320)) AS st FROM documents WHERE length(text) > 0) SELECT doc_id, st // 320 AS chunk_no, st AS char_start, st + length(substr(text, st + 1, 400)) AS char_end, substr(text, st + 1, 400) AS chunk FROM s",
    "sentence_chunks": r"""WITH RECURSIVE m AS (SELECT doc_id, text AS t, regexp_extract_all(text, '(?s).*?[.!?][ \t\n\r\f\v]+') AS parts FROM documents WHERE length(text) > 0),
        e AS (SELECT doc_id, t, length(t) AS n, list_append([list_sum([length(x) for x in parts[1:i]]) for i in range(1, len(parts) + 1)], length(t)) AS ends FROM m),
        c AS (SELECT doc_id, t, n, ends, CAST(0 AS BIGINT) AS st, CAST(CASE WHEN 400 >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda x: x > 0 AND x <= 400)), 400) END AS BIGINT) AS en FROM e
        UNION ALL SELECT doc_id, t, n, ends, greatest(en - 80, st + 1), CAST(CASE WHEN greatest(en - 80, st + 1) + 400 >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda x: x > greatest(en - 80, st + 1) AND x <= greatest(en - 80, st + 1) + 400)), greatest(en - 80, st + 1) + 400) END AS BIGINT) FROM c WHERE greatest(en - 80, st + 1) < n)
        """ + _NUMBERED,
    "knowledge_chunks": r"""WITH RECURSIVE e AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
        f AS (SELECT doc_id, t, length(t) AS n FROM e WHERE length(t) > 0),
        c AS (SELECT doc_id, t, n, CAST(0 AS BIGINT) AS st, CAST(CASE WHEN n <= 1536 THEN n WHEN contains(substr(t, 769, 768), ' ') THEN 1536 - instr(reverse(substr(t, 769, 768)), ' ') ELSE 1536 END AS BIGINT) AS en FROM f
        UNION ALL SELECT doc_id, t, n, greatest(en - 192, st + 1), CAST(CASE WHEN greatest(en - 192, st + 1) + 1536 >= n THEN n WHEN contains(substr(t, greatest(en - 192, st + 1) + 769, 768), ' ') THEN greatest(en - 192, st + 1) + 1536 - instr(reverse(substr(t, greatest(en - 192, st + 1) + 769, 768)), ' ') ELSE greatest(en - 192, st + 1) + 1536 END AS BIGINT) FROM c WHERE en < n)
        """ + _NUMBERED,
    "shard_layout": f"WITH r AS (SELECT vec_id, len(embedding) AS dim, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT vec_id, k // {SHARD_ROWS} AS shard, (k % {SHARD_ROWS}) * dim * 4 AS byte_offset FROM r",
    "pretoken_freq": f"SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY piece",
    "pair_freq": f"WITH p AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY piece HAVING length(piece) > 1), a AS (SELECT piece, n, unnest(range(1, length(piece))) AS i FROM p) SELECT substr(piece, i, 2) AS pair, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1",
    "token_windows": f"WITH r AS (SELECT doc_id, {_PIECES} AS tokens FROM documents), s AS (SELECT doc_id, tokens, unnest(range(0, len(tokens) - {WINDOW}, {STRIDE})) AS start FROM r WHERE len(tokens) > {WINDOW}) SELECT doc_id, start, md5(array_to_string(tokens[start + 1 : start + {WINDOW}], chr(31))) AS input_md5, md5(array_to_string(tokens[start + 2 : start + {WINDOW} + 1], chr(31))) AS target_md5 FROM s",
    "corpus_windows": f"""WITH r AS (SELECT doc_id, {_PIECES} AS p FROM documents), t AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS tok FROM r), n AS (SELECT count(*) AS n, CASE WHEN count(*) BETWEEN 1 AND {WINDOW} THEN CAST(ceil({WINDOW + 2} / count(*)) AS BIGINT) ELSE 1 END AS turns FROM t),
        g AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS k, tok FROM t), c AS (SELECT k, tok, n, turns, unnest(range(turns)) AS turn FROM g, n), a AS (SELECT k + turn * n AS k, tok, n * turns AS total FROM c),
        w AS (SELECT k, tok, total, unnest(range(greatest(0, (k - {WINDOW} + {STRIDE} - 1) // {STRIDE}), k // {STRIDE} + 1)) * {STRIDE} AS start FROM a)
        SELECT start, md5(string_agg(tok, chr(31) ORDER BY k) FILTER (k < start + {WINDOW})) AS input_md5, md5(string_agg(tok, chr(31) ORDER BY k) FILTER (k > start)) AS target_md5 FROM w WHERE k <= start + {WINDOW} AND start < total - {WINDOW} GROUP BY start""",
}
