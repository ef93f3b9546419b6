"""Splitting oversized chunks at natural boundaries by lexical cohesion.

For each boundary of a text (paragraph, sentence or line end) the words before and after it are compared as two blocks; the
similarity has valleys where the topic changes. Pieces are cut from left to right: in each window of admissible ends the
paragraph or sentence end in the deepest valley is taken; where there is none, the last line end, else the last word end,
else the text is cut at the limit. The next piece starts `overlap` characters before the end of the one before.

Offsets: a chunk's own char_start and char_end are believed where their difference fits its text (with or without padding);
offsets that are null, zero for a later chunk, or counted in bytes are derived from the neighbouring chunk of the file, whose
text overlaps by `overlap` characters; where no neighbour is known either, the offsets of the pieces are null.

Defined results: null and blank texts give no piece; a text within the limit is one piece; surrounding blanks, tabs and line
breaks belong to no piece; rows delivered twice (same chunk_id) are one chunk, rows with a null chunk_id none; characters are
Unicode code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 400
OVERLAP = 80
BLOCK_WORDS = 30
PIECE_SCHEMA = "chunk_id string, source string, piece int, n_pieces int, text string, char_start long, char_end long"

_WORD = re.compile(r"[^\W_]+")
_STRONG = re.compile(r"\n[ \t]*\n\s*|[.!?…]+[\"'”’»)\]]*(?=\s)\s+|[。！？]+[”’」）]*")
_LINE = re.compile(r"[^\S\n]*\n\s*")
_BLANK = re.compile(r"\s+")
_EDGE = re.compile(r"[^\w\s.,]|_")


def cohesion_depths(text: str, boundaries: list[int]) -> np.ndarray:
    """Depth of the valley at each boundary: how far the similarity of the blocks around it lies below the peaks beside it.

    The peak on either side is found by climbing from the boundary as long as the similarity does not fall.
    """
    words = [(m.start(), m[0].lower()) for m in _WORD.finditer(text)]
    at = np.searchsorted([p for p, _ in words], boundaries)
    similarity = []
    for k in at.tolist():
        left, right = (Counter(w for _, w in block) for block in (words[max(0, k - BLOCK_WORDS) : k], words[k : k + BLOCK_WORDS]))
        norm = sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        similarity.append(sum(n * right[w] for w, n in left.items()) / norm if norm else 0.0)
    peaks = []
    for row in (similarity, similarity[::-1]):
        climbed = []
        for i, x in enumerate(row):
            climbed.append(climbed[-1] if i and row[i - 1] >= x else x)
        peaks.append(climbed)
    return np.array(peaks[0]) + np.array(peaks[1][::-1]) - 2 * np.array(similarity)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, each at most limit long, neighbours sharing overlap characters."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    strong = [m.end() for m in _STRONG.finditer(text)]
    depth = cohesion_depths(text, strong)
    strong_at = np.array(strong, dtype=int)
    weaker = [np.array([m.end() for m in pattern.finditer(text)], dtype=int) for pattern in (_LINE, _BLANK, _EDGE)]
    pieces, start = [], 0
    while True:
        if len(text) - start <= limit:
            pieces.append((start, len(text)))
            return pieces
        most = start + limit
        end = most
        for least in (start + limit // 2, start + overlap + 1):
            lo, hi = np.searchsorted(strong_at, (least, most + 1))
            if lo < hi:
                end = int(strong_at[lo + np.argmax(depth[lo:hi])])
                break
        else:
            for ends in weaker:
                last = int(np.searchsorted(ends, most + 1)) - 1
                if last >= 0 and ends[last] >= start + limit // 2:
                    end = int(ends[last])
                    break
        pieces.append((start, end))
        start = end - overlap


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for chunk, source, text, base, lead in zip(pdf["chunk_id"], pdf["source"], pdf["text"], pdf["base"], pdf["lead"]):
                body = text.strip(" \t\r\n")
                skipped = len(text) - len(text.lstrip(" \t\r\n"))
                pieces = split_text(body, limit, overlap)
                first = None if pd.isna(base) else int(base) + skipped - int(lead)
                out += [(chunk, source, i, len(pieces), body[s:e], None if first is None else first + s, None if first is None else first + e) for i, (s, e) in enumerate(pieces)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])
            yield frame.astype({"char_start": "Int64", "char_end": "Int64"})

    return run


def known_offsets(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """One row for each chunk: base is where its text starts in the file, not counting `lead` characters of padding."""
    trimmed = F.expr("trim(BOTH ' \t\r\n' FROM text)")
    leading = F.length("text") - F.length(F.expr("trim(LEADING ' \t\r\n' FROM text)"))
    number = F.coalesce(F.col("metadata")["document_chunk"].try_cast("int"), F.regexp_extract("chunk_id", r"(\d+)$", 1).try_cast("int"))
    rows = chunks.select("chunk_id", "source", "text", "char_start", "char_end", number.alias("number")).filter("chunk_id is not null and text is not null")
    rows = rows.groupBy("chunk_id").agg(F.min(F.struct("source", "text", "char_start", "char_end", "number")).alias("r")).select("chunk_id", "r.*")
    span = F.col("char_end") - F.col("char_start")
    whole, padded = span == F.length("text"), span == F.length(trimmed)
    honest = (F.col("char_start") > 0) | (F.coalesce("number", F.lit(0)) == 0)
    rows = rows.withColumn("length", F.when(padded & ~whole, F.length(trimmed)).otherwise(F.length("text"))).withColumn("lead", F.when(padded & ~whole, leading).otherwise(0))
    rows = rows.withColumn("base", F.when(honest & (whole | padded), F.col("char_start").cast("long")))
    near = rows.filter("base is not null and number is not null").select("source", "number", "base", "length")
    before = near.select("source", (F.col("number") + 1).alias("number"), F.greatest(F.col("base") + F.col("length") - overlap, F.col("base") + 1).alias("from_before"))
    after = near.select("source", (F.col("number") - 1).alias("number"), (F.col("base") + overlap).alias("end_by_next"))
    before, after = (x.groupBy("source", "number").agg(F.min(c).alias(c)) for x, c in ((before, "from_before"), (after, "end_by_next")))
    rows = rows.join(before, ["source", "number"], "left").join(after, ["source", "number"], "left")
    return rows.withColumn("base", F.coalesce("base", "from_before", F.greatest(F.lit(0), F.col("end_by_next") - F.col("length")))).select("chunk_id", "source", "text", "base", "lead")


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    return known_offsets(chunks, overlap).mapInPandas(_split(limit, overlap), PIECE_SCHEMA)
