"""Chunking of documents.

Fixed windows are made in the JVM; sentence and knowledge chunks, whose next start depends on the last end, by a small function
over whole texts in Arrow batches, one text at a time however long.

Defined results: null and empty texts give no chunk, blank pieces are left out; positions are code points; rows with equal
doc_id are chunked each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

CHUNK_SCHEMA = "doc_id long, chunk_no long, char_start long, char_end long, chunk string"
_SENTENCE = re.compile(r"[.!?][ \t\n\r\f\v]+")


def fixed_chunks(documents: DataFrame, size: int = 400, overlap: int = 80) -> DataFrame:
    """Windows of `size` characters, each starting size - overlap after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    rows = documents.select("doc_id", "text").filter(F.length("text") > 0)
    starts = rows.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("chunk_no", "start"))
    chunk = F.substring("text", F.col("start") + 1, F.lit(size))
    return starts.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("char_start"), (F.col("start") + F.length(chunk)).cast("long").alias("char_end"), chunk.alias("chunk"))


def sentence_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks end at the last sentence end within size, else at size; the next starts overlap before, at least one further.

    Chunks go on until a start reaches the end of the text, so a text's tail is covered by a row of shrinking chunks.
    """
    ends = [m.end() for m in _SENTENCE.finditer(text)] + [len(text)]
    out, start, at = [], 0, 0
    while start < len(text):
        while at < len(ends) and ends[at] <= start:
            at += 1
        end, k = start + size, at
        while k < len(ends) and ends[k] <= start + size:
            end = ends[k]
            k += 1
        end = min(end, len(text))
        out.append((start, end))
        start = max(end - overlap, start + 1)
    return out


def knowledge_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks end at the last blank in the second half of the window; the last one ends the text."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            blank = text.rfind(" ", start + max(1, size // 2), end)
            end = blank if blank > 0 else end
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def _spans(of: Callable, size: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                kept = [(s, e, text[s:e].strip(" \t\n\r\f\v")) for s, e in of(text, size, overlap)]
                out += [(doc, i, s, e, chunk) for i, (s, e, chunk) in enumerate((x for x in kept if x[2]))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "char_start", "char_end", "chunk"])

    return run


def sentence_chunks(documents: DataFrame, size: int = 400, overlap: int = 80) -> DataFrame:
    return documents.select("doc_id", "text").filter(F.length("text") > 0).mapInPandas(_spans(sentence_spans, size, overlap), CHUNK_SCHEMA)


def knowledge_chunks(documents: DataFrame, size: int = 1536, overlap: int = 192) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    return documents.select("doc_id", clean.alias("text")).filter(F.length("text") > 0).mapInPandas(_spans(knowledge_spans, size, overlap), CHUNK_SCHEMA)


def chunks_by(documents: DataFrame, strategy: str = "sentence", size: int = 400, overlap: int = 80) -> DataFrame:
    """Chunks of the texts without the white space around them, by sentence or of fixed size; blank texts have none."""
    if strategy not in ("sentence", "fixed"):
        raise ValueError(f"no strategy {strategy!r}")
    return (sentence_chunks if strategy == "sentence" else fixed_chunks)(documents.select("doc_id", strip(F.col("text")).alias("text")), size, overlap)
