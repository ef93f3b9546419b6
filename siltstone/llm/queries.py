"""Queries of the numbered problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .blend import SEED, blend, blend_shares
from .conversations import conversation_defects, conversations, ordered_messages, sender_offsets
from .defects import pair_defects, pair_labels
from .leaks import item_matches, leaked_items
from .overlap import overlap_report, split_overlaps
from .packing import CAPACITY, pack_documents
from .quality import document_kinds
from .splitting import split_chunks
from .tokens import token_budget


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(table(spark, sf_dir, "text_chunks")).filter("n_pieces > 1 and piece = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(table(spark, sf_dir, "text_chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(table(spark, sf_dir, "prepare_openorca")).select("row_id", "defect")


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label whose posterior exceeds its cutoff, several for a row where they apply."""
    return pair_labels(table(spark, sf_dir, "prepare_openorca"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = split_overlaps(table(spark, sf_dir, "split_rows"))
    return pairs.select(F.least("val_row", "train_row").alias("row_id_a"), F.greatest("val_row", "train_row").alias("row_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping val rows and pairs, per corpus and source of the val row and split of the training row."""
    return overlap_report(table(spark, sf_dir, "split_rows"))


def p5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(table(spark, sf_dir, "documents"), table(spark, sf_dir, "text_chunks"), table(spark, sf_dir, "ingestion_stats"))


def p6_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend(table(spark, sf_dir, "split_rows"), table(spark, sf_dir, "blend_targets"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend_shares(table(spark, sf_dir, "split_rows"), table(spark, sf_dir, "blend_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_defects(ordered_messages(table(spark, sf_dir, "messages")))
    return found.filter("defect is not null").select("conversation_id", "defect")


def p7_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "messages"))


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of p7_conversations with their instants as sent, in microseconds."""
    return conversations(table(spark, sf_dir, "messages")).select("conversation_id", "turn", "role", "content", F.unix_micros("instant").alias("sent_us"))


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock offsets of the senders of each conversation, in seconds, where they are not zero."""
    return sender_offsets(table(spark, sf_dir, "messages"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers are filled to which twentieth of their capacity."""
    filled = pack_documents(table(spark, sf_dir, "documents")).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return filled.groupBy((F.ceil(F.col("tokens") * 20 / CAPACITY) / 20).alias("filled_to")).agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item with other numbers, names or units, and no passage of it as it stands."""
    found = item_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).filter("not leaks")
    return found.select("doc_id", "item_id", "alike", "other_values")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_kinds(table(spark, sf_dir, "documents")).filter("kind != 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_kinds(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_labels": p2_labels,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_budget": p5_budget,
    "p6_blend": p6_blend,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_conversations": p7_conversations,
    "p7_turns": p7_turns,
    "p7_offsets": p7_offsets,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_templates": p9_templates,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}
#: The messages d without copies, and the defect f of each conversation.
_DEFECTS = r"""WITH m AS (SELECT id, conversation_id, content, lower(regexp_replace(coalesce(role, ''), '[\s\pZ\pC]+', '', 'g')) AS r, CAST(CASE WHEN regexp_matches(trim(created_at), '(Z|[+-]\d{2}:?\d{2})$') AND contains(created_at, ':') THEN trim(created_at) ELSE trim(created_at) || 'Z' END AS TIMESTAMPTZ) AS ts FROM messages WHERE conversation_id IS NOT NULL),
        c AS (SELECT id, conversation_id AS cid, content, ts, CASE WHEN r = 'human' THEN 'user' WHEN r IN ('gpt', 'bot') THEN 'assistant' ELSE r END AS role FROM m),
        d AS (SELECT cid, role, content, ts, min(id) AS id, coalesce(regexp_matches(content, '[^\s\pZ\pC]'), false) AS visible FROM c GROUP BY cid, role, content, ts),
        t AS (SELECT cid, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM d WHERE visible AND role IN ('user', 'assistant') WINDOW w AS (PARTITION BY cid ORDER BY ts, id)),
        s AS (SELECT cid, bool_or(role = 'assistant' AND coalesce(before, 'assistant') = 'assistant') AS broken, bool_or(role = 'user' AND coalesce(after, 'user') = 'user') AS missing FROM t GROUP BY cid),
        a AS (SELECT d.cid, bool_or(role NOT IN ('user', 'assistant', 'system', 'tool')) AS strange FROM d GROUP BY d.cid),
        f AS (SELECT a.cid AS conversation_id, CASE WHEN s.cid IS NULL THEN 'empty' WHEN strange OR broken THEN 'broken' WHEN missing THEN 'missing_reply' END AS defect FROM a LEFT JOIN s ON a.cid = s.cid)
        """
#: The blend's plan: p has a row for each target, u the rows that each is to give.
_PLAN = """have AS (SELECT source, count(*) AS n FROM split_rows WHERE lower(trim(split)) IN ('train', 'pretrain') AND source IS NOT NULL GROUP BY source),
        t AS (SELECT source, greatest(coalesce(max(weight), 0), 0) AS w, coalesce(max(requested_rows), 0) AS req, greatest(coalesce(max(max_repeats), 1), 0) AS passes FROM blend_targets WHERE source IS NOT NULL GROUP BY source),
        p AS (SELECT t.*, coalesce(n, 0) AS have, coalesce(n, 0) * passes AS cap, (SELECT sum(req) FROM t) AS total, (SELECT sum(w) FROM t) AS ws FROM t LEFT JOIN have ON t.source = have.source),
        o AS (SELECT *, cap / w AS ratio, sum(cap) OVER () - sum(cap) OVER k AS before, sum(w) OVER k AS rest FROM p WHERE w > 0 AND cap > 0 WINDOW k AS (ORDER BY cap / w DESC, source ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT *, (total - before) / rest >= ratio AS clamped FROM o),
        l AS (SELECT greatest(0, (max(total) - coalesce(sum(cap) FILTER (clamped), 0)) / sum(w) FILTER (NOT clamped)) AS level FROM c),
        d AS (SELECT source, have, cap, CASE WHEN clamped THEN cap ELSE least(cap, w * level) END AS due FROM c, l),
        f AS (SELECT *, floor(due + 1e-9) AS base, row_number() OVER (ORDER BY due - floor(due + 1e-9) DESC, source) AS k FROM d),
        u AS (SELECT source, have, CAST(least(cap, base + CASE WHEN k <= (SELECT round(sum(due)) - sum(base) FROM f) THEN 1 ELSE 0 END) AS BIGINT) AS used FROM f)"""
ORACLES: dict[str, str] = {
    "p6_blend": f"""WITH {_PLAN}, r AS (SELECT s.source, row_id, used, have, row_number() OVER (PARTITION BY s.source ORDER BY md5('{SEED}:' || s.source || ':' || row_id), row_id) AS k FROM split_rows s JOIN u ON s.source = u.source WHERE lower(trim(split)) IN ('train', 'pretrain'))
        SELECT source, row_id, unnest(range(1, used // have + CASE WHEN k <= used % have THEN 1 ELSE 0 END + 1)) AS copy FROM r""",
    "p6_shares": f"""WITH {_PLAN} SELECT p.source, round(w / ws, 6) AS target_share, round(w / ws * total, 6) AS target_rows, p.have AS available_rows, passes AS max_repeats, least(p.have, coalesce(used, 0)) AS distinct_rows,
        CAST(coalesce(ceil(used / p.have), 0) AS BIGINT) AS most_uses, coalesce(used, 0) AS reached_rows, round(coalesce(used, 0) / (SELECT sum(used) FROM u), 6) AS reached_share FROM p LEFT JOIN u ON p.source = u.source""",
    "p1_found": "SELECT DISTINCT chunk_id FROM text_chunks WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 400",
    "p7_found": _DEFECTS + "SELECT conversation_id, defect FROM f WHERE defect IS NOT NULL",
    "p7_turns": _DEFECTS + "SELECT cid AS conversation_id, row_number() OVER (PARTITION BY cid ORDER BY ts, id) AS turn, role, content, epoch_us(ts) AS sent_us FROM d WHERE cid IN (SELECT conversation_id FROM f WHERE defect IS NULL)",
}
