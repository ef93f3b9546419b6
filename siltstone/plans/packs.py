"""Queries on training rows: encoding, instruction packing, batches, held-out rows, cleaned answers, rules, hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, normalize, pieces, strip
from ..functions.tokenizer import PATTERN, decode, encode
from ..operators.lexical import small_enough
from ..operators.ranking import positions
from ..session import stage, table
from .retrieval import ORACLES as SEARCHES
from .retrieval import dense_search, phrase_search

LENGTH = 64
BATCH = 32
HELD = 0.02
MOST, LEAST = 800, 100
FALLBACK = "[The model is still learning — try rephrasing your question or add more documents to the knowledge base.]"
ROLES = r"<\|(?:user|assistant|system)\|>"
META = r"(?iu)(the given task is|here is a step[^\n]by[^\n]step|step [\p{Nd}]+:|determine if|find the appropriate|the problem is|let's see|okay,)[^\n]*\n?"
#: The first rule that matches names the text.
RULES = (("table", r"\|.*\|"), ("hex", r"^[0-9a-f]{8} "), ("list", r"^(- |\* |\[.?\] |[0-9]+[.)] )"), ("dialogue", r"^(Operator|Assistant):"), ("heading", r"^# "))


def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under a public tokenizer, and whether decoding gives the text back.

    Texts are cut into pieces that no merge crosses; every distinct piece is encoded once, however often it occurs, and the
    documents' totals are summed over their pieces.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = encode(pdf["piece"])
            yield pd.DataFrame({"piece": pdf["piece"], "tokens": tokens.map(len), "same": decode(tokens) == pdf["piece"]})

    texts = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATTERN), F.lit(0)).alias("pieces"))
    used = stage(texts.select("doc_id", F.explode("pieces").alias("piece")).groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    known = small_enough(stage(used.select("piece").distinct().mapInPandas(counted, "piece string, tokens int, same boolean"), "tokens"))
    sums = used.join(known, "piece").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("tokens")).alias("n_tokens"), F.min("same").alias("round_trip"))
    return texts.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("round_trip", F.lit(True)).alias("round_trip"))


def instruct_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and targets of LENGTH: the prompt's end, the answer's start, an end mark; prompt and padding are masked."""
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", pieces(F.col("question")).alias("q"), pieces(F.col("response")).alias("a")).filter("size(q) > 0 and size(a) > 0")
    k = F.least(F.size("q"), F.lit((LENGTH + 1) // 2))
    rows = rows.withColumn("k", k).withColumn("seq", F.concat(F.slice("q", F.size("q") - k + 1, k), F.slice("a", 1, F.lit(LENGTH) - k), F.array(F.lit("<eos>"))))
    n = F.size("seq")
    inputs = F.concat(F.slice("seq", F.lit(1), n - 1), F.array_repeat(F.lit("<pad>"), F.lit(LENGTH + 1) - n))
    targets = F.concat(F.array_repeat(F.lit("<mask>"), F.col("k") - 1), F.slice("seq", F.col("k") + 1, n), F.array_repeat(F.lit("<mask>"), F.lit(LENGTH + 1) - n))
    return rows.select("row_id", F.md5(F.array_join(inputs, "\x1f")).alias("input_md5"), F.md5(F.array_join(targets, "\x1f")).alias("target_md5"))


def _shuffled(spark: SparkSession, sf_dir: str, seed: int) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("h"))
    return positions(rows, ["h", "doc_id"])


def seeded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a seeded order, in full batches."""
    n = table(spark, sf_dir, "documents").count()
    return _shuffled(spark, sf_dir, 7).filter(F.col("position") <= n // BATCH * BATCH).select("doc_id", F.floor((F.col("position") - 1) / BATCH).cast("long").alias("batch"))


def random_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact share of the documents, at least one and not all, picked by a seeded order."""
    n = table(spark, sf_dir, "documents").count()
    held = min(max(int(n * HELD), 1), n - 1)
    return _shuffled(spark, sf_dir, 11).select("doc_id", F.when(F.col("position") <= held, "val").otherwise("train").alias("split"))


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of numbered answers."""
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", F.posexplode(F.split("response", "\n")).alias("line", "t"))
    rows = rows.select("row_id", F.col("line").cast("long").alias("line"), F.regexp_extract("t", r"^\s*(\d{1,3})[.)]\s+(.+)$", 1).alias("number"), F.regexp_extract("t", r"^\s*(\d{1,3})[.)]\s+(.+)$", 2).alias("step"))
    return rows.filter("number != ''")


def clean_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without markers and label, at most three paragraphs and 800 characters, cut after a full stop if one is late.

    `cleaned_answers` has all stages.
    """
    t = F.regexp_replace(F.coalesce("response", F.lit("")), r"<\|[^|<>]*\|>", "")
    t = F.regexp_replace(t, r"^\s*(Q:|A:|Question:|Answer:|###)\s*", "")
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", F.array_join(F.slice(F.split(t, "\n\n"), 1, 3), "\n\n").alias("t"))
    head = F.left("t", F.lit(800))
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    cut = F.when(F.length("t") <= 800, F.col("t")).when((F.locate(".", head) > 0) & (stop > 100), F.left(head, stop)).otherwise(head)
    return rows.select("row_id", normalize(cut).alias("answer"))


def cleaned(raw: Column, prompt: Column) -> Column:
    """A raw answer without markers, echoed prompt, thoughts, label, meta-commentary and loops, capped; FALLBACK if nothing is left."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), "<bos>|<eos>", "")
    t = F.regexp_replace(t, ROLES, "")
    asked = strip(F.regexp_replace(F.replace(F.coalesce(prompt, F.lit("")), F.lit("<bos>")), ROLES, ""))
    t = F.when((asked != "") & F.startswith(strip(t), asked), F.substr(strip(t), F.length(asked) + 1)).otherwise(t)
    t = F.regexp_replace(t, r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?s)<think>.*", "")
    t = F.regexp_replace(t, rf"^[{BLANKS}]*(Q:|A:|### Response:|### Instruction:)[{BLANKS}]*", "")
    t = F.regexp_replace(t, META, "")
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_])([\p{{L}}\p{{N}}_]+)([{BLANKS}]+\1){{3,}}", "$1 $1")
    t = strip(F.regexp_replace(t, rf"([^\p{{L}}\p{{N}}_{BLANKS}]){{5,}}", "$1$1"))
    head = F.left(t, F.lit(MOST))
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    late = (F.locate(".", head) > 0) & (stop - 1 > LEAST)
    t = F.when(F.length(t) <= MOST, t).when(late, F.left(head, stop)).otherwise(F.concat(strip(head), F.lit("…")))
    paragraphs = F.filter(F.transform(F.split(t, "\n\n"), strip), lambda p: p != "")
    return F.when(F.size(paragraphs) > 0, F.array_join(F.slice(paragraphs, 1, 3), "\n\n")).otherwise(FALLBACK)


def cleaned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response cleaned by all stages, its question being the prompt."""
    return table(spark, sf_dir, "prepare_openorca").select("row_id", cleaned(F.col("response"), F.col("question")).alias("answer"))


def first_match(c: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The name of the first rule whose pattern is found."""
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(default) if out is not None else F.lit(default)


def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", first_match(F.col("text"), RULES, "text").alias("label"))


def right_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last LENGTH pre-tokens of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", pieces(F.col("text")).alias("p")).filter("size(p) > 0")
    k = F.least(F.size("p"), F.lit(LENGTH))
    return rows.select("doc_id", F.md5(F.array_join(F.slice("p", F.size("p") - k + 1, k), "\x1f")).alias("context_md5"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of the dense and the lexical results of every item, by raw score; a document may come twice."""
    dense = dense_search(spark, sf_dir).select("item_id", "doc_id", "score", F.lit("dense").alias("branch"))
    both = dense.unionByName(phrase_search(spark, sf_dir).select("item_id", "doc_id", "score", F.lit("lexical").alias("branch")))
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "branch", "doc_id")  # six rows an item
    return both.withColumn("rank", F.row_number().over(best).cast("long")).filter("rank <= 3")


QUERIES = {f.__name__: f for f in (bpe_encode, instruct_pack, seeded_batches, random_holdout, numbered_items, clean_output, cleaned_answers, rule_labels, right_context, hybrid_search)}

_PIECES = r"coalesce(regexp_extract_all({c}, ' ?[\p{{L}}\p{{N}}_]+| ?[^\sA-Za-z0-9_]+|\s+'), [])"
_SHUFFLED = "SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR))), doc_id) AS k FROM documents"
_CASES = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in RULES)

ORACLES = {
    "hybrid_search": f"WITH b AS (SELECT item_id, doc_id, score, 'dense' AS branch FROM ({SEARCHES['dense_search']}) UNION ALL SELECT item_id, doc_id, score, 'lexical' AS branch FROM ({SEARCHES['phrase_search']})), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, branch, doc_id) AS rank FROM b) SELECT item_id, doc_id, score, branch, rank FROM r WHERE rank <= 3",
    "instruct_pack": f"WITH p AS (SELECT row_id, {_PIECES.format(c='question')} AS q, {_PIECES.format(c='response')} AS a FROM prepare_openorca), k AS (SELECT *, least(len(q), 32) AS k FROM p WHERE len(q) > 0 AND len(a) > 0), s AS (SELECT row_id, k, q[len(q) - k + 1 : len(q)] || a[1 : 64 - k] || ['<eos>'] AS seq FROM k) SELECT row_id, md5(array_to_string(seq[1 : len(seq) - 1] || list_resize(CAST([] AS VARCHAR[]), 65 - len(seq), '<pad>'), chr(31))) AS input_md5, md5(array_to_string(list_resize(CAST([] AS VARCHAR[]), k - 1, '<mask>') || seq[k + 1 : len(seq)] || list_resize(CAST([] AS VARCHAR[]), 65 - len(seq), '<mask>'), chr(31))) AS target_md5 FROM s",
    "seeded_batches": f"WITH r AS ({_SHUFFLED.format(seed=7)}) SELECT doc_id, (k - 1) // {BATCH} AS batch FROM r WHERE k <= (SELECT count(*) FROM documents) // {BATCH} * {BATCH}",
    "random_holdout": f"WITH r AS ({_SHUFFLED.format(seed=11)}) SELECT doc_id, CASE WHEN k <= least(greatest(CAST(floor((SELECT count(*) FROM documents) * {HELD}) AS BIGINT), 1), (SELECT count(*) FROM documents) - 1) THEN 'val' ELSE 'train' END AS split FROM r",
    "numbered_items": r"WITH l AS (SELECT row_id, generate_subscripts(string_split(response, chr(10)), 1) - 1 AS line, unnest(string_split(response, chr(10))) AS t FROM prepare_openorca WHERE response IS NOT NULL), r AS (SELECT row_id, CAST(line AS BIGINT) AS line, regexp_extract(t, '^\s*(\d{1,3})[.)]\s+(.+)$', 1) AS number, regexp_extract(t, '^\s*(\d{1,3})[.)]\s+(.+)$', 2) AS step FROM l) SELECT * FROM r WHERE number <> ''",
    "clean_output": r"WITH t AS (SELECT row_id, regexp_replace(regexp_replace(coalesce(response, ''), '<\|[^|<>]*\|>', '', 'g'), '^\s*(Q:|A:|Question:|Answer:|###)\s*', '') AS t FROM prepare_openorca), p AS (SELECT row_id, array_to_string(string_split(t, chr(10) || chr(10))[1:3], chr(10) || chr(10)) AS t FROM t), h AS (SELECT row_id, t, substr(t, 1, 800) AS head FROM p), s AS (SELECT *, length(head) - instr(reverse(head), '.') + 1 AS stop FROM h) SELECT row_id, trim(regexp_replace(CASE WHEN length(t) <= 800 THEN t WHEN contains(head, '.') AND stop > 100 THEN substr(head, 1, stop) ELSE head END, '[\s\pZ]+', ' ', 'g')) AS answer FROM s",
    "rule_labels": f"SELECT doc_id, CASE {_CASES} ELSE 'text' END AS label FROM documents",
    "right_context": f"WITH p AS (SELECT doc_id, {_PIECES.format(c='text')} AS p FROM documents) SELECT doc_id, md5(array_to_string(p[greatest(1, len(p) - {LENGTH} + 1) : len(p)], chr(31))) AS context_md5 FROM p WHERE len(p) > 0",
}
