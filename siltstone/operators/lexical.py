"""Exact lexical candidates by rare terms first, and inverse document frequencies.

A document among an item's k best by matched terms matches at least as many as the k-th best does. A lower bound of that
number comes from the documents that hold the item's rarest terms; a document with m matches of n terms holds at least one of
the n - m + 1 rarest, so the more frequent terms, which most documents hold, are never looked up. Matches are then counted
over the whole term lists of the candidates.

Defined results: null texts have no terms; items without terms have no candidates; ties of the k-th best are candidates too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, stage

RARE_PART = 3
TERMS_BROADCAST = 500_000


def small_enough(df: DataFrame, most: int = TERMS_BROADCAST) -> DataFrame:
    """df (staged), to be broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def document_frequencies(terms: DataFrame) -> DataFrame:
    """(term, df) of (doc_id, terms) with distinct terms in a row."""
    return terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def best_within_slices(df: DataFrame, item: str, doc: str, order: list[Column], k: int) -> DataFrame:
    """The k best rows of each item, sought first within slices of its documents so that no item's rows meet in one task."""
    part = Window.partitionBy(item, F.pmod(F.xxhash64(doc), F.lit(4 * partitions(df.sparkSession)))).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def rare_first_matches(docs: DataFrame, items: DataFrame, k: int, least: Column | None = None) -> DataFrame:
    """(item_id, doc_id, n, matched) of every document that can be among an item's k best, and of every one with at least
    `least` (a column of items) matches. docs(doc_id, terms), items(item_id, terms): terms are distinct within a row."""
    docs, items = stage(docs.filter("size(terms) > 0"), "terms"), items.filter("size(terms) > 0")
    least = F.lit(None).cast("int") if least is None else least
    asked = stage(items.select("item_id", F.size("terms").alias("n"), least.alias("least"), F.explode("terms").alias("term")), "asked")
    wanted = small_enough(stage(asked.select("term").distinct(), "wanted"))
    postings = stage(docs.select("doc_id", F.explode("terms").alias("term")).join(wanted, "term", "left_semi"), "postings")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("item_id").orderBy("df", "term")  # an item's own terms
    asked = stage(asked.join(df, "term").withColumn("place", F.row_number().over(rarest)), "asked")
    rare = small_enough(asked.filter(F.col("place") <= F.ceil(F.col("n") / RARE_PART)).select("item_id", "term"))
    first = postings.join(rare, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"))
    bound = best_within_slices(first, "item_id", "doc_id", [F.col("matched").desc(), F.col("doc_id")], k).filter(F.col("rank") == k).select("item_id", F.col("matched").alias("bound"))
    need = F.greatest(F.lit(1), F.least(F.coalesce("bound", F.lit(1)), F.coalesce("least", F.lit(2**31 - 1))))
    prefix = stage(asked.join(bound, "item_id", "left").filter(F.col("place") <= F.col("n") - need + 1).select("item_id", "term"), "prefix")
    candidates = postings.join(small_enough(prefix), "term").select("item_id", "doc_id").distinct()
    lists = small_enough(stage(items.select("item_id", F.col("terms").alias("asked")), "lists"))
    met = candidates.join(docs, "doc_id").join(lists, "item_id")
    return met.select("item_id", "doc_id", F.size("asked").alias("n"), F.size(F.array_intersect("asked", "terms")).alias("matched"))
