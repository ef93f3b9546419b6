"""Word forms and word distances shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"<\|[^|<>]*\|>"
WORD = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
_SIGNS = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(c: Column | str) -> Column:
    """Lower-case runs of letters and digits; chat markers do not count; null gives no words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_extract_all(F.lower(F.regexp_replace(c, MARKER, " ")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def runs_of(text: str) -> list[str]:
    """Runs of letters and digits; ASCII texts are cut without a pattern, which is several times as fast."""
    return text.translate(_SIGNS).split() if text.isascii() else _WORD.findall(text)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes that are equal on every machine."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True) if len(words) else np.zeros(0, np.uint64)


def word_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two word lists in order; any value above most means: further than most. Bit-parallel in len(a)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, cost, left = full, 0, len(a), len(b)
    for w in b:
        eq = at.get(w, 0)
        x = eq | down
        diagonal = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        left -= 1
        cost += 1 if plus & top else -1 if minus & top else 0
        if cost - left > most:
            return most + 1
        plus, minus = (plus << 1) | 1, minus << 1
        up, down = (minus & full) | (full & ~(diagonal | plus)), plus & diagonal & full
    return cost
