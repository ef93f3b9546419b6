import hashlib
import re
from pathlib import Path

import pandas as pd
import pytest

from siltstone.plans import queries
from siltstone.plans.chunks import stream_windows

DATA = "/root/testdata/sf0.001"
PIECE = re.compile(r" ?\w+| ?[^\sA-Za-z0-9_]+|\s+")


def md5(tokens):
    return hashlib.md5("\x1f".join(tokens).encode()).hexdigest()


def plain(texts, window, stride):
    """The reference's windows: one stream, repeated if too short."""
    tokens = [p for _, t in sorted(texts) for p in PIECE.findall(t or "")]
    if len(tokens) < window + 1:
        tokens = tokens * -(-(window + 2) // max(len(tokens), 1))
    return sorted((s, md5(tokens[s : s + window]), md5(tokens[s + 1 : s + window + 1])) for s in range(0, len(tokens) - window, stride))


@pytest.mark.parametrize("window, stride", [(8, 4), (8, 3), (3, 5), (200, 7)])
def test_windows_run_over_the_whole_stream(spark, window, stride):
    texts = [(i, "pump seal " * (i % 7) + f"unit {i}") for i in range(30)] + [(90, ""), (91, None), (92, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, stream_windows(df, "doc_id", window, stride).collect())) == plain(texts, window, stride)


@pytest.mark.parametrize("texts", [[(1, "a b"), (2, "c")], [(1, "a")], [(1, "a b c d e f g h")], [(1, None)], []])
def test_short_streams_repeat(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, stream_windows(df, "doc_id", 8, 4).collect())) == plain(texts, 8, 4)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_corpus_windows_of_the_tables(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    tokens = [(i, len(PIECE.findall(t or ""))) for i, t in zip(docs.doc_id, docs.text)]
    starts = sorted(r.start for r in queries()["corpus_windows"](spark, DATA).collect())
    assert starts == list(range(0, sum(n for _, n in tokens) - 64, 32))
