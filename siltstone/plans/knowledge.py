"""Queries on knowledge: source templates, ingestion totals, chunk identifiers, citations, prompts, saved indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import templates
from ..functions.text import estimate_tokens, normalize, short_id
from ..operators import chunking
from ..operators.ranking import positions
from ..operators.search import vector_top_k
from ..session import shared_dir, stage, table
from ..sources import index
from .chunks import ORACLES as CHUNKS
from .retrieval import ORACLES as SEARCHES
from .retrieval import phrase_search

LEAST_DOCUMENT = 200
CONTEXT_CHARS = 2000
SHARD_ROWS = 128
#: Words that mark a technical question, as parts of other words too.
TECHNICAL = (
    "engine", "motor", "pressure", "flow", "valve", "sensor", "pipe", "mechanical", "electrical", "circuit", "chemical", "physics", "math", "calcul", "formula", "equation", "analyse", "analysis", "report",
    "procedure", "safety", "inspection", "maintenance", "technical", "system", "data", "measure", "process", "temperature", "force", "python", "code", "function", "algorithm", "program", "software",
    "science", "engineering", "industrial", "plant", "compressor", "pump",
)
TAG = "[A-Z]{1,3}-[0-9]+[A-Z]?"
OPENING = r"^[A-Za-z]+"


def source_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four kinds as training texts, one under another: chats, work orders, questions, documents."""
    rows = table(spark, sf_dir, "prepare_openorca")
    q, r, s = F.col("question"), F.col("response"), F.col("system")
    chat = F.array(F.struct(F.lit("system").alias("role"), s.alias("content")), F.struct(F.lit("user").alias("role"), q.alias("content")))
    order = templates.work_order_text(F.regexp_extract("question", TAG, 0), F.regexp_extract("question", OPENING, 0), q, r)
    parts = [(rows, "row_id", "chat", templates.answered_chat_text(chat, r)), (rows, "row_id", "work_order", order), (rows, "row_id", "question", templates.question_text(s, q, r))]
    parts.append((table(spark, sf_dir, "documents"), "doc_id", "document", templates.document_text(F.col("text"))))
    texts = None
    for df, key, kind, text in parts:
        part = df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), text.alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    return texts.filter("text != ''").select("kind", "key", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def technical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("system", "question", "response")]))
    return table(spark, sf_dir, "prepare_openorca").filter(said.rlike("|".join(TECHNICAL))).select("row_id")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge chunks of documents that are long enough, named by their document, place and text."""
    rows = table(spark, sf_dir, "documents").filter(F.length(normalize(F.col("text"))) >= LEAST_DOCUMENT)
    document_id = short_id(F.coalesce("source_path", F.lit("")), F.col("doc_id").cast("string"), F.substring("text", 1, 256))
    named = chunking.knowledge_chunks(rows).join(rows.select("doc_id", document_id.alias("document_id")), "doc_id")
    return named.select(short_id(F.col("document_id"), F.col("char_start").cast("string"), F.col("chunk")).alias("chunk_id"), "document_id", "chunk_no", estimate_tokens(F.col("chunk")).alias("estimated_tokens"))


def ingestion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on an ingestion of all documents: seen, accepted, skipped, chunks, tokens of the sources and of the chunks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", normalize(F.col("text")).alias("t"))
    accepted = F.length("t") >= LEAST_DOCUMENT
    seen = rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("skipped"), F.coalesce(F.sum(F.when(accepted, estimate_tokens(F.col("t")))), F.lit(0)).alias("source_tokens"))
    chunks = chunking.knowledge_chunks(rows.filter(accepted)).agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(estimate_tokens(F.col("chunk"))), F.lit(0)).alias("chunk_tokens"))
    return seen.withColumn("one", F.lit(1)).join(chunks.withColumn("one", F.lit(1)), "one").drop("one")  # a row on either side


def citation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each item's three best documents, numbered by rank."""
    found = phrase_search(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    line = F.concat(F.lit("  ["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.format_string(" (relevance: %.2f)", F.round("score", 2)))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")  # three an item
    return found.groupBy("item_id").agg(F.concat(F.lit("\n**Sources:**\n"), block).alias("block"))


def context_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a question after as many of its best documents, in order, as fit the context."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("]: "), F.coalesce("text", F.lit(""))).alias("snippet"))
    found = phrase_search(spark, sf_dir).join(docs, "doc_id")
    ranked = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # three an item
    found = found.withColumn("total", F.sum(F.length("snippet")).over(ranked)).filter(F.col("total") <= CONTEXT_CHARS)
    context = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]), "\n").alias("context"))
    items = table(spark, sf_dir, "eval_items").select("item_id", F.coalesce("text", F.lit("")).alias("text")).join(context, "item_id", "left")
    prompt = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "text", F.lit("\nAnswer from the context only:"))
    return items.select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.md5(prompt).alias("prompt_md5"))


def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks saved as an index, loaded, and given other vectors: what else a record holds is as before."""
    chunks = table(spark, sf_dir, "text_chunks").filter("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct("source", "text")).alias("r")).select("chunk_id", "r.*")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save_index(chunks.withColumn("embedding", F.array(F.length("text").cast("double"))), path)
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit("[a-z]+"), F.lit(0))).cast("double")
    found = index.rebuild_vectors(index.load_index(spark, path, "chunk_id string, source string, text string, embedding array<double>"), F.array(words, F.length("text").cast("double")))
    return found.select("chunk_id", "source", F.md5("text").alias("text_md5"), F.size("embedding").cast("long").alias("dim"), F.get("embedding", F.lit(0)).alias("first"))


def shard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written in shards with their records beside; a search over the shards, then only the winners' records are read."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    path = f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}"
    index.write_knowledge(rows, path, ["vec_id"], SHARD_ROWS)
    vectors = index.read_vectors(spark, path).select((F.col("shard").cast("long") * SHARD_ROWS + F.col("row")).alias("id"), F.col("embedding").alias("vector"))
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = stage(vector_top_k(vectors, asked, 3, 64, ties="high"), "best")
    place = {"shard": F.floor(F.col("id") / SHARD_ROWS).cast("int"), "row": (F.col("id") % SHARD_ROWS).cast("int")}
    picked = best.withColumns(place).select("shard", "row", "query_id", "rank")
    found = index.read_picked(spark, path, "vec_id long, label long", picked)
    return found.select("query_id", "rank", "vec_id", "label", F.col("shard").cast("long").alias("shard"), F.col("row").cast("long").alias("row"))


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events whose value is below that of every earlier event of their type."""
    rows = table(spark, sf_dir, "events").filter("value is not null").select("event_type", "ts", "event_id", "value")
    placed = positions(rows, ["ts", "event_id"], ["event_type"], least={"best": F.col("value")})
    return placed.filter("best is null or value < best").select("event_type", "event_id", "value")


def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty characters of what the user says first in each conversation, by id."""
    rows = table(spark, sf_dir, "messages").select("conversation_id", "id", F.lower(F.trim("role")).alias("role"), normalize(F.col("content")).alias("content"))
    rows = rows.filter("conversation_id is not null and role in ('user', 'human') and content != ''")
    return rows.groupBy("conversation_id").agg(F.left(F.min_by("content", "id"), F.lit(60)).alias("title"))


def row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work rows as `column: value | ...` texts, those of fifty characters or more."""
    columns = ("source", "system", "question", "response")
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", F.lit("prepare_openorca").alias("source"), "system", "question", "response")
    part = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in columns]
    return rows.select("row_id", F.concat_ws(" | ", *part).alias("t")).filter(F.length("t") >= 50).select("row_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


def stripped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks of the documents without the white space around them."""
    return chunking.chunks_by(table(spark, sf_dir, "documents"), "fixed").select("doc_id", "chunk_no", "char_start", "char_end", F.md5("chunk").alias("chunk_md5"))


QUERIES = {f.__name__: f for f in (row_documents, stripped_chunks, source_templates, technical_rows, document_chunks, ingestion_totals, citation_blocks, context_prompts, index_rebuild, shard_search, running_best, conversation_titles)}

_NORM = r"trim(regexp_replace(coalesce({c}, ''), '[\s\pZ]+', ' ', 'g'))"
_CUT = "CASE WHEN length({t}) <= 2000 THEN {t} WHEN contains(substr({t}, 1, 2000), '.') AND 2000 - instr(reverse(substr({t}, 1, 2000)), '.') > 500 THEN substr({t}, 1, 2001 - instr(reverse(substr({t}, 1, 2000)), '.')) ELSE substr({t}, 1, 2000) END"
_ID = "substr(sha256(concat_ws(':', coalesce(source_path, ''), CAST(doc_id AS VARCHAR), substr(text, 1, 256))), 1, 24)"
_LONG = f"length({_NORM.format(c='text')}) >= {LEAST_DOCUMENT}"
_BEST = f"b AS ({SEARCHES['phrase_search']})"

ORACLES = {
    "row_documents": "WITH r AS (SELECT row_id, concat_ws(' | ', 'source: prepare_openorca', CASE WHEN system <> '' THEN 'system: ' || system END, CASE WHEN question <> '' THEN 'question: ' || question END, CASE WHEN response <> '' THEN 'response: ' || response END) AS t FROM prepare_openorca) SELECT row_id, length(t) AS n_chars, md5(t) AS text_md5 FROM r WHERE length(t) >= 50",
    "stripped_chunks": r"WITH d AS (SELECT doc_id, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\pZ]+|[\s\x0B\x1C-\x1F\x{85}\pZ]+$', '', 'g') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, length(t), 320)) AS st FROM d WHERE length(t) > 0) SELECT doc_id, st // 320 AS chunk_no, st AS char_start, st + length(substr(t, st + 1, 400)) AS char_end, md5(substr(t, st + 1, 400)) AS chunk_md5 FROM s",
    "source_templates": f"""WITH r AS (SELECT row_id, {_NORM.format(c='system')} AS s, {_NORM.format(c='question')} AS q, {_NORM.format(c='response')} AS a, coalesce(system, '') = '' AS none, regexp_extract(question, '{TAG}') AS tag, regexp_extract(question, '{OPENING}') AS op FROM prepare_openorca),
        d AS (SELECT doc_id, {_NORM.format(c='text')} AS t FROM documents),
        x AS (SELECT 'chat' AS kind, row_id AS key, concat_ws(' ', CASE WHEN s <> '' THEN '<|system|> ' || s END, CASE WHEN q <> '' THEN '<|user|> ' || q END) || ' <|assistant|> ' || a AS text FROM r WHERE (s <> '' OR q <> '') AND a <> ''
        UNION ALL SELECT 'work_order', row_id, '<|user|> Create a safe maintenance work instruction. ' || concat_ws(' ', CASE WHEN tag <> '' THEN 'Equipment: ' || tag || '.' END, CASE WHEN op <> '' THEN 'Order type: ' || op || '.' END) || ' Issue: ' || q || ' <|assistant|> ' || a FROM r WHERE q <> '' AND a <> ''
        UNION ALL SELECT 'question', row_id, '<|system|> ' || CASE WHEN none THEN '{templates.SYSTEM}' ELSE s END || ' <|user|> ' || q || ' <|assistant|> ' || a FROM r WHERE q <> '' AND a <> ''
        UNION ALL SELECT 'document', doc_id, {_CUT.format(t='t')} FROM d WHERE length(t) >= 100)
        SELECT kind, key, length(text) AS n_chars, md5(text) AS text_md5 FROM x""",
    "technical_rows": f"SELECT row_id FROM prepare_openorca WHERE regexp_matches(lower(coalesce(system, '') || ' ' || coalesce(question, '') || ' ' || coalesce(response, '')), '{'|'.join(TECHNICAL)}')",
    "document_chunks": f"WITH k AS ({CHUNKS['knowledge_chunks']}), i AS (SELECT doc_id, {_ID} AS document_id FROM documents WHERE {_LONG}) SELECT substr(sha256(document_id || ':' || char_start || ':' || chunk), 1, 24) AS chunk_id, document_id, chunk_no, CAST(greatest(1, ceil(length(chunk) / 4.0)) AS BIGINT) AS estimated_tokens FROM k JOIN i USING (doc_id)",
    "ingestion_totals": f"WITH k AS ({CHUNKS['knowledge_chunks']}), i AS (SELECT doc_id, length({_NORM.format(c='text')}) AS n FROM documents), a AS (SELECT * FROM i WHERE n >= {LEAST_DOCUMENT}) SELECT (SELECT count(*) FROM i) AS seen, (SELECT count(*) FROM a) AS accepted, (SELECT count(*) FROM i) - (SELECT count(*) FROM a) AS skipped, (SELECT CAST(coalesce(sum(greatest(1, ceil(n / 4.0))), 0) AS BIGINT) FROM a) AS source_tokens, count(*) AS chunks, CAST(coalesce(sum(greatest(1, ceil(length(chunk) / 4.0))), 0) AS BIGINT) AS chunk_tokens FROM k WHERE doc_id IN (SELECT doc_id FROM a)",
    "citation_blocks": f"WITH {_BEST} SELECT item_id, chr(10) || '**Sources:**' || chr(10) || string_agg('  [' || rank || '] ' || coalesce(documents.source, '') || printf(' (relevance: %.2f)', round(b.score, 2)), chr(10) ORDER BY rank) AS block FROM b JOIN documents USING (doc_id) GROUP BY item_id",
    "context_prompts": f"WITH {_BEST}, s AS (SELECT item_id, rank, '[' || coalesce(d.source, '') || ']: ' || coalesce(d.text, '') AS snippet FROM b JOIN documents d USING (doc_id)), t AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY item_id ORDER BY rank) AS total FROM s), c AS (SELECT item_id, count(*) AS n, string_agg(snippet, chr(10) ORDER BY rank) AS context FROM t WHERE total <= {CONTEXT_CHARS} GROUP BY item_id) SELECT i.item_id, coalesce(n, 0) AS documents, md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || coalesce(text, '') || chr(10) || 'Answer from the context only:') AS prompt_md5 FROM eval_items i LEFT JOIN c USING (item_id)",
    "index_rebuild": "WITH c AS (SELECT chunk_id, min({'source': source, 'text': text}) AS r FROM text_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id) SELECT chunk_id, r.source AS source, md5(r.text) AS text_md5, 2 AS dim, CAST(len(regexp_extract_all(r.text, '[a-z]+')) AS DOUBLE) AS first FROM c",
    "shard_search": f"WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.*, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q, e WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 10) DESC, k DESC) AS rank FROM p) SELECT query_id, rank, vec_id, CAST(label AS BIGINT) AS label, k // {SHARD_ROWS} AS shard, k % {SHARD_ROWS} AS row FROM r WHERE rank <= 3",
    "running_best": "WITH r AS (SELECT event_type, event_id, value, min(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WHERE value IS NOT NULL) SELECT event_type, event_id, value FROM r WHERE best IS NULL OR value < best",
    "conversation_titles": f"WITH r AS (SELECT conversation_id, id, {_NORM.format(c='content')} AS t FROM messages WHERE conversation_id IS NOT NULL AND lower(trim(role)) IN ('user', 'human')) SELECT conversation_id, left(arg_min(t, id), 60) AS title FROM r WHERE t <> '' GROUP BY conversation_id",
}
