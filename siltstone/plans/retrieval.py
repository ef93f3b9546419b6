"""Queries on retrieval: term weights, exact vector and lexical search, index maintenance, citations, context packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import QUESTION_STOPS, SEARCH_STOPS, normalize, passage_terms, question_terms, terms, words
from ..operators.lexical import best_within_slices, rare_first_matches, small_enough
from ..operators.ranking import positions
from ..operators.search import vector_top_k
from ..session import stage, table

DIM = 64
TOP = 5
TEXT_DIM = 128
CONTEXT_CHARS = 2000


def tfidf_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per term, and ln(N / (df + 1))."""
    rows = table(spark, sf_dir, "documents").select(words(F.col("text")).alias("w"))
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.round(F.log(F.lit(float(n)) / (F.col("df") + 1)), 6).alias("idf"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and term: share of the document's words times the term's idf."""
    rows = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    counts = stage(rows.select("doc_id", F.size("w").alias("total"), F.explode("w").alias("term")).groupBy("doc_id", "total", "term").agg(F.count(F.lit(1)).alias("n")), "counts")
    df = stage(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    return counts.join(small_enough(df), "term").select("doc_id", "term", F.round(F.col("n") / F.col("total") * F.log(F.lit(float(rows.count())) / (F.col("df") + 1)), 6).alias("weight"))


def _bucket(term: str) -> Column:
    """A bucket of TEXT_DIM that is equal on every machine."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % TEXT_DIM).cast("int")


def _weights(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """(id, bucket, value) of texts (id, w: words): share of the text's words times idf, 1 for a term that `fitted` (term, idf)
    has not; summed in hashed buckets."""
    counts = rows.select("id", F.size("w").alias("total"), F.explode("w").alias("term")).groupBy("id", "total", "term").agg(F.count(F.lit(1)).alias("n"))
    value = F.sum(F.col("n") / F.col("total") * F.coalesce("idf", F.lit(1.0))).alias("value")
    return counts.join(fitted, "term", "left").groupBy("id", _bucket("term").alias("bucket")).agg(value)


def _dense(buckets: pd.Series, values: pd.Series) -> pd.Series:
    """Vectors of length one; a text whose weights are all zero keeps zeros."""
    out = np.zeros((len(buckets), TEXT_DIM))
    for row, b, v in zip(out, buckets, values):
        row[np.asarray(b, dtype=int)] = v
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return pd.Series(list(out / np.where(lengths > 0, lengths, 1)))


def fitted_terms(documents: DataFrame) -> DataFrame:
    """(term, idf) of texts (id, w: words), to be broadcast where there are few enough: hot terms then meet no join key."""
    n = documents.filter("size(w) > 0").count()
    df = documents.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return small_enough(stage(df.select("term", F.log(F.lit(float(n)) / (F.col("df") + 1)).alias("idf")), "idf"))


def text_vectors(texts: DataFrame, fitted: DataFrame) -> DataFrame:
    """(id, vector) of texts (id, w), weighted by the fitted frequencies. Empty texts have no vector."""
    placed = texts.filter("size(w) > 0").repartition("id")  # shuffled once; all that follows stays within a text's partition
    packed = _weights(placed, fitted).groupBy("id").agg(F.collect_list(F.struct("bucket", "value")).alias("v"))  # at most TEXT_DIM a text
    return packed.select("id", F.pandas_udf(_dense, "array<double>")("v.bucket", "v.value").alias("vector"))


def _worded(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return stage(table(spark, sf_dir, name).select(F.col(key).alias("id"), words(F.col("text")).alias("w")), "words")


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' hashed vectors under the documents' term frequencies; terms of no document weigh as one."""
    vectors = text_vectors(_worded(spark, sf_dir, "eval_items", "item_id"), fitted_terms(_worded(spark, sf_dir, "documents", "doc_id")))
    return vectors.select(F.col("id").alias("item_id"), F.posexplode("vector").alias("bucket", "value")).filter("value != 0").select("item_id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


def text_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document against all documents, by cosine of hashed term weights."""
    docs = _worded(spark, sf_dir, "documents", "doc_id")
    vectors = stage(text_vectors(docs, fitted_terms(docs)), "vectors")
    return vector_top_k(vectors, vectors.filter("id % 100 = 0"), TOP, TEXT_DIM).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to every item, by cosine of hashed term weights fitted to the documents."""
    docs = _worded(spark, sf_dir, "documents", "doc_id")
    fitted = fitted_terms(docs)
    found = vector_top_k(text_vectors(docs, fitted), text_vectors(_worded(spark, sf_dir, "eval_items", "item_id"), fitted), 3, TEXT_DIM)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def evidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best documents of each item that score 0.2 or more and share a term with it."""
    found = dense_search(spark, sf_dir).filter("rank <= 2 and score >= 0.2")
    items = table(spark, sf_dir, "eval_items").select("item_id", question_terms(F.col("text")).alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id", passage_terms(F.col("text")).alias("p"))
    return found.join(items, "item_id").join(docs, "doc_id").filter((F.size("q") == 0) | F.arrays_overlap("q", "p")).select("item_id", "doc_id", "rank", "score")


def vector_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot-product search where ties go to the later row; only the winners' records are read for their label."""
    rows = _vectors(spark, sf_dir)
    found = vector_top_k(rows, rows.filter("id % 100 = 0"), TOP, DIM, cosine=False, ties="high")
    return found.join(rows.select("id", "label"), "id").select("query_id", "rank", "id", F.col("label").cast("long").alias("label"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vector_top_k(rows, rows.filter("id % 100 = 0"), TOP, DIM).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def vector_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vector_top_k(rows, rows.filter("id % 100 = 0"), TOP, DIM, cosine=False).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def vector_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search within one label; what scores below the least score is dropped after the top k are found."""
    rows = _vectors(spark, sf_dir)
    found = vector_top_k(rows.filter("label = 3"), rows.filter("id % 100 = 0"), TOP, DIM)
    return found.filter(F.round("score", 4) >= 0.2).select("query_id", "id", "rank")


def dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(F.count_if(F.size("embedding") == DIM).alias("usable"), F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) != DIM).alias("skipped"))


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label of the query: share of queries with another vector of that label among the first five."""
    rows = _vectors(spark, sf_dir)
    found = vector_top_k(rows, rows.filter("id % 100 = 0"), TOP, DIM)
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    hits = found.filter("id != query_id").join(label, "id").withColumnRenamed("label", "found").join(label.withColumnRenamed("id", "query_id"), "query_id")
    hits = hits.groupBy("query_id", "label").agg(F.max(F.col("found") == F.col("label")).alias("hit"))
    return hits.groupBy("label").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's terms against the terms of all documents: matched share, three best documents; see `phrase_search`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", terms(F.col("text")).alias("terms"))
    items = table(spark, sf_dir, "eval_items").select("item_id", terms(F.col("text")).alias("terms"))
    scored = rare_first_matches(docs, items, 3).withColumn("score", F.col("matched") / F.col("n"))
    best = best_within_slices(scored, "item_id", "doc_id", [F.col("score").desc(), F.col("doc_id")], 3)
    return best.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's terms against all documents by matched share, a bonus for the phrase of all terms and one for its early place.

    Blanks enclose the phrase's inner terms, so a document that holds it matches all of them that are terms as they stand: only
    candidates with as many matches are joined to their text.
    """
    lowered = F.replace(F.lower("text"), F.lit("calliper"), F.lit("caliper"))
    docs = table(spark, sf_dir, "documents").select("doc_id", lowered.alias("lowered"), F.length("text").alias("chars"))
    items = table(spark, sf_dir, "eval_items").select("item_id", terms(lowered).alias("terms"))
    inner = F.filter("terms", lambda w, i: (i > 0) & (i < F.size("terms") - 1) & (F.length(w) >= 4) & ~w.isin(*SEARCH_STOPS))
    items = items.select("item_id", "terms", F.array_join("terms", " ").alias("phrase"), F.size(inner).alias("least"))
    matched = rare_first_matches(docs.select("doc_id", terms(F.col("lowered")).alias("terms")), items, 3, F.col("least"))
    kept = stage(matched.join(items.select("item_id", "least", "phrase"), "item_id").withColumn("score", F.col("matched") / F.col("n")), "candidates")
    near = kept.filter("matched >= least").join(docs, "doc_id").withColumn("at", F.instr("lowered", F.col("phrase")))
    bonus = F.when(F.col("at") > 0, 0.5 + 0.25 * (1 - (F.col("at") - 1) / F.greatest("chars", F.lit(1)))).otherwise(0.0)
    scored = kept.filter("matched < least").select("item_id", "doc_id", "score").unionByName(near.select("item_id", "doc_id", (F.col("score") + bonus).alias("score")))
    best = best_within_slices(scored, "item_id", "doc_id", [F.col("score").desc(), F.col("doc_id")], 3)
    return best.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that share a term with their question; a question without terms keeps its response."""
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", question_terms(F.col("question")).alias("q"), passage_terms(F.col("response")).alias("r"))
    return rows.filter((F.size("q") == 0) | F.arrays_overlap("q", "r")).select("row_id")


def extractive_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of a response around the first term of its question."""
    rows = table(spark, sf_dir, "prepare_openorca").select("row_id", question_terms(F.col("question")).alias("q"), normalize(F.col("response")).alias("t")).filter("t != ''")
    at = F.array_min(F.filter(F.transform("q", lambda w: F.instr(F.lower(F.col("t")), w) - 1), lambda p: p >= 0))
    rows = rows.withColumn("at", at).withColumn("start", F.greatest(F.lit(0), F.col("at") - 150))
    cut = F.substring("t", F.col("start") + 1, F.lit(560))
    reply = F.when(F.col("at").isNull(), F.left("t", F.lit(420))).otherwise(F.concat(F.when(F.col("start") > 0, "…").otherwise(""), cut, F.when(F.length("t") > F.col("start") + 560, "…").otherwise("")))
    return rows.select("row_id", reply.alias("reply"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a conversation in order of id, as long as their characters together fit the context."""
    rows = table(spark, sf_dir, "messages").filter("conversation_id is not null").select("conversation_id", "id", F.length(F.coalesce("content", F.lit(""))).alias("chars"))
    packed = positions(rows, ["id"], ["conversation_id"], {"total": F.col("chars")})
    return packed.filter(F.col("total") <= CONTEXT_CHARS).select("conversation_id", "id", F.col("total").cast("long").alias("running_chars"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_chunks").select("chunk_id", F.format_string("[Source: %s, %s]", "source", "chunk_id").alias("citation")).distinct()


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and distinct chunks per file."""
    rows = table(spark, sf_dir, "text_chunks").groupBy("source", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("chunk_rows"), F.count(F.lit(1)).alias("chunks"))


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a batch that changes every third vector's label: the last writer wins."""
    old = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).alias("batch"))
    new = old.filter("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("batch"))
    return old.unionByName(new).groupBy("vec_id").agg(F.max_by("label", "batch").cast("long").alias("label"))


def index_import_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a batch that the index has not: right dimension, unknown id."""
    rows = table(spark, sf_dir, "embeddings")
    batch = rows.select((F.col("vec_id") + F.lit(250)).alias("vec_id"), "embedding", "label").filter(F.size("embedding") == DIM)
    return batch.join(rows.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.col("label").cast("long").alias("label"))


QUERIES = {f.__name__: f for f in (tfidf_df, tfidf_weights, tfidf_vectors, text_top_k, dense_search, evidence_policy, vector_payload, vector_topk_cosine, vector_topk_dot, vector_source_filter, dim_guard, hit_at_k, lexical_search, phrase_search, evidence_filter, extractive_reply, context_pack, citations, source_counts, index_upsert, index_import_new)}

_WORDS = "coalesce(regexp_extract_all(lower({c}), '[a-z]+'), [])"
_RUNS = "coalesce(regexp_extract_all(lower({c}), '[a-z0-9]+'), [])"
_TERMS = "list_distinct([regexp_replace(w, 's+$', '') for w in " + _RUNS + " if length(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in SEARCH_STOPS) + ")])"
_SINGULAR = "[CASE WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END for w in [CASE v WHEN 'calliper' THEN 'caliper' WHEN 'callipers' THEN 'calipers' ELSE v END for v in {v}]]"
_QUESTION = _SINGULAR.replace("{v}", "[u for u in " + _RUNS + " if length(u) >= 4 AND u NOT IN (" + ", ".join(f"'{w}'" for w in QUESTION_STOPS) + ")]")
_PASSAGE = _SINGULAR.replace("{v}", _RUNS)
_PAIRS = "SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, q.label AS query_label, {score} AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND len(e.embedding) = 64 AND len(q.embedding) = 64"
_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
_DOT = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(s, 10) DESC, id)"
_REPLY = f"WITH r AS (SELECT row_id, {_QUESTION.format(c='question')} AS q, trim(regexp_replace(coalesce(response, ''), '[\\s\\pZ]+', ' ', 'g')) AS t FROM prepare_openorca), a AS (SELECT row_id, t, list_min(list_filter([instr(lower(t), w) - 1 for w in q], lambda p: p >= 0)) AS pos FROM r WHERE t <> '') SELECT row_id, CASE WHEN pos IS NULL THEN substr(t, 1, 420) ELSE CASE WHEN pos > 150 THEN '…' ELSE '' END || substr(t, greatest(0, pos - 150) + 1, 560) || CASE WHEN length(t) > greatest(0, pos - 150) + 560 THEN '…' ELSE '' END END AS reply FROM a"

#: Document frequencies f, and a text's hashed weights: {t} of table {s} with key {k}.
_FITTED = f"d AS (SELECT doc_id AS id, {_WORDS.format(c='text')} AS w FROM documents), n AS (SELECT count(*) AS n FROM d WHERE len(w) > 0), f AS (SELECT term, ln((SELECT n FROM n) / (count(*) + 1)) AS idf FROM (SELECT unnest(list_distinct(w)) AS term FROM d) GROUP BY term)"
_HASHED = "{t} AS (SELECT id, bucket, sum(v) AS v FROM (SELECT id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 128 AS bucket, count(*) / any_value(total) * coalesce(any_value(idf), 1.0) AS v FROM (SELECT {k} AS id, len({w}) AS total, unnest({w}) AS term FROM {s}) x LEFT JOIN f USING (term) GROUP BY id, term) GROUP BY id, bucket), {t}n AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {t})"
_DOCS_HASHED = _HASHED.format(t="hd", k="id", w="w", s="d")
_ITEMS_HASHED = _HASHED.format(t="hi", k="item_id", w=_WORDS.format(c="text"), s="eval_items")
_NEAREST = "s AS (SELECT q.id AS query_id, e.id, sum(q.v * e.v) AS s FROM {q} q JOIN hdn e ON q.bucket = e.bucket GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 10) DESC, id) AS rank FROM s)"
_DENSE = f"WITH {_FITTED}, {_DOCS_HASHED}, {_ITEMS_HASHED}, {_NEAREST.format(q='hin')}"

ORACLES = {
    "tfidf_vectors": f"WITH {_FITTED}, {_ITEMS_HASHED} SELECT id AS item_id, bucket, round(v, 6) AS value FROM hin WHERE v <> 0",
    "text_top_k": f"WITH {_FITTED}, {_DOCS_HASHED}, {_NEAREST.format(q='(SELECT * FROM hdn WHERE id % 100 = 0)')} SELECT query_id, id, rank, round(s, 6) AS score FROM r WHERE rank <= 5",
    "dense_search": f"{_DENSE} SELECT query_id AS item_id, id AS doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 3",
    "evidence_policy": f"{_DENSE} SELECT query_id AS item_id, r.id AS doc_id, rank, round(s, 6) AS score FROM r JOIN eval_items i ON i.item_id = query_id JOIN documents x ON x.doc_id = r.id WHERE rank <= 2 AND round(s, 6) >= 0.2 AND (len({_QUESTION.format(c='i.text')}) = 0 OR list_has_any({_QUESTION.format(c='i.text')}, {_PASSAGE.format(c='x.text')}))",
    "vector_payload": f"WITH p AS ({_PAIRS.format(score=_DOT)}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 10) DESC, id DESC) AS rank FROM p) SELECT query_id, rank, id, CAST(label AS BIGINT) AS label FROM r WHERE rank <= 5",
    "tfidf_df": f"WITH d AS (SELECT unnest(list_distinct({_WORDS.format(c='text')})) AS term FROM documents) SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / (count(*) + 1)), 6) AS idf FROM d GROUP BY term",
    "tfidf_weights": f"WITH d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents), x AS (SELECT doc_id, len(w) AS total, unnest(w) AS term FROM d), c AS (SELECT doc_id, term, count(*) AS n, any_value(total) AS total FROM x GROUP BY doc_id, term), f AS (SELECT term, count(*) AS df FROM c GROUP BY term) SELECT doc_id, c.term, round(n / total * ln((SELECT count(*) FROM documents) / (df + 1)), 6) AS weight FROM c JOIN f ON c.term = f.term",
    "vector_topk_cosine": f"WITH p AS ({_PAIRS.format(score=_COSINE)}), r AS (SELECT *, {_TOP} AS rank FROM p) SELECT query_id, id, rank, round(s, 5) AS score FROM r WHERE rank <= 5",
    "vector_topk_dot": f"WITH p AS ({_PAIRS.format(score=_DOT)}), r AS (SELECT *, {_TOP} AS rank FROM p) SELECT query_id, id, rank, round(s, 5) AS score FROM r WHERE rank <= 5",
    "vector_source_filter": f"WITH p AS ({_PAIRS.format(score=_COSINE)} AND e.label = 3), r AS (SELECT *, {_TOP} AS rank FROM p) SELECT query_id, id, rank FROM r WHERE rank <= 5 AND round(s, 4) >= 0.2",
    "dim_guard": "SELECT label, count(*) FILTER (len(embedding) = 64) AS usable, count(*) FILTER (coalesce(len(embedding), 0) <> 64) AS skipped FROM embeddings GROUP BY label",
    "hit_at_k": f"WITH p AS ({_PAIRS.format(score=_COSINE)}), r AS (SELECT *, {_TOP} AS rank FROM p), h AS (SELECT query_id, query_label AS label, max(CASE WHEN label = query_label THEN 1 ELSE 0 END) AS hit FROM r WHERE rank <= 5 AND id <> query_id GROUP BY ALL) SELECT label, count(*) AS queries, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate FROM h GROUP BY label",
    "lexical_search": f"WITH d AS (SELECT doc_id, unnest({_TERMS.format(c='text')}) AS term FROM documents), i AS (SELECT item_id, {_TERMS.format(c='text')} AS t FROM eval_items), x AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM i), m AS (SELECT item_id, n, doc_id, count(*) AS matched FROM d JOIN x ON d.term = x.term GROUP BY ALL), r AS (SELECT *, matched / n AS score, row_number() OVER (PARTITION BY item_id ORDER BY matched / n DESC, doc_id) AS rank FROM m) SELECT item_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3",
    "phrase_search": f"WITH d AS (SELECT doc_id, text, replace(lower(text), 'calliper', 'caliper') AS low FROM documents), i AS (SELECT item_id, {_TERMS.format(c="replace(lower(text), 'calliper', 'caliper')")} AS t FROM eval_items), e AS (SELECT doc_id, unnest({_TERMS.format(c='low')}) AS term FROM d), x AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM i), m AS (SELECT item_id, n, doc_id, count(*) AS matched FROM e JOIN x ON e.term = x.term GROUP BY ALL), p AS (SELECT m.*, instr(low, array_to_string(t, ' ')) AS pos, length(text) AS chars FROM m JOIN i USING (item_id) JOIN d USING (doc_id)), s AS (SELECT item_id, doc_id, matched / n + CASE WHEN pos > 0 THEN 0.5 + CAST(0.25 AS DOUBLE) * (1 - (pos - 1) / greatest(chars, 1)) ELSE 0 END AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3",
    "evidence_filter": f"WITH r AS (SELECT row_id, {_QUESTION.format(c='question')} AS q, {_PASSAGE.format(c='response')} AS a FROM prepare_openorca) SELECT row_id FROM r WHERE len(q) = 0 OR list_has_any(q, a)",
    "extractive_reply": _REPLY,
    "context_pack": f"WITH r AS (SELECT conversation_id, id, CAST(sum(length(coalesce(content, ''))) OVER (PARTITION BY conversation_id ORDER BY id) AS BIGINT) AS running_chars FROM messages WHERE conversation_id IS NOT NULL) SELECT * FROM r WHERE running_chars <= {CONTEXT_CHARS}",
    "citations": "SELECT DISTINCT chunk_id, '[Source: ' || source || ', ' || chunk_id || ']' AS citation FROM text_chunks",
    "source_counts": "SELECT source, count(*) AS chunk_rows, count(DISTINCT chunk_id) AS chunks FROM text_chunks GROUP BY source",
    "index_upsert": "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS BIGINT) AS label FROM embeddings",
    "index_import_new": "SELECT vec_id + 250 AS vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE len(embedding) = 64 AND vec_id + 250 NOT IN (SELECT vec_id FROM embeddings)",
}
