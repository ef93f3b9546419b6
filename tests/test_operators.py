import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.chunking import fixed_chunks, knowledge_spans, sentence_spans
from siltstone.operators.ranking import positions
from siltstone.operators.search import vector_top_k


def test_positions_with_a_hot_key_and_nulls(spark):
    rows = [("hot", i) for i in range(200)] + [("b", i) for i in range(5)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = positions(df, ["v"], ["k"], {"total": F.col("v")}).toPandas()
    for key, part in got.groupby("k", dropna=False):
        part = part.sort_values("v")
        assert part["position"].tolist() == list(range(1, len(part) + 1))
        assert part["total"].tolist() == part["v"].cumsum().tolist()
    assert positions(df.limit(0), ["v"]).count() == 0
    assert positions(df.withColumn("position", F.lit("x")), ["v", "k"]).schema["position"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("cosine,numbers,ties", [(True, 10**6, "low"), (False, 10**6, "high"), (True, 0, "low"), (False, 0, "high")])
def test_top_k_equals_brute_force(spark, cosine, numbers, ties, monkeypatch):
    """With queries sent to the tasks, and with so many that they stay a table."""
    from siltstone.operators import search

    monkeypatch.setattr(search, "QUERY_NUMBERS", numbers)

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "DATA_BLOCK", 20)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 4)).round(2)
    x[7] = 0
    x[20] = x[10]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(500, None), (501, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = vector_top_k(df, df.filter("id % 10 = 0"), 3, 4, cosine, ties).toPandas()
    norm = np.linalg.norm(x, axis=1)
    for q in range(0, 100, 10):
        s = x @ x[q]
        if cosine:
            s = np.where(norm > 0, s / np.where(norm > 0, norm, 1), 0) / norm[q]
        best = sorted(range(100), key=lambda i: (-round(s[i], 9), i if ties == "low" else -i))[:3]
        assert got[got.query_id == q].sort_values("rank")["id"].tolist() == best
    assert vector_top_k(df, df.limit(0), 3, 4, cosine, ties).count() == 0 == vector_top_k(df.limit(0), df.filter("id < 5"), 3, 4, cosine, ties).count()


def test_fixed_chunks_rebuild_the_text(spark):
    rows = [(1, "abcdefghij" * 50), (2, ""), (3, None), (4, "ä漢" * 200)]
    got = fixed_chunks(spark.createDataFrame(rows, "doc_id long, text string"), 40, 10).toPandas()
    assert set(got.doc_id) == {1, 4}
    for _, r in got.iterrows():
        assert dict(rows)[r.doc_id][r.char_start : r.char_end] == r.chunk
    with pytest.raises(ValueError):
        fixed_chunks(spark.createDataFrame(rows, "doc_id long, text string"), 10, 10)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n漢", max_size=300))
def test_spans_cover_the_text(t):
    for spans in (sentence_spans(t, 40, 10), knowledge_spans(t, 40, 10)):
        at = 0
        for s, e in spans:
            assert s <= at and s < e <= len(t) and e - s <= 40
            at = max(at, e)
        assert at == len(t)


def test_text_functions(spark):
    df = spark.createDataFrame([(None,), ("",), (" a  \n b ",), ("x" * 1200 + ". " + "y" * 1200,)], "t string")
    got = df.select(text.normalize(F.col("t")).alias("n"), text.estimate_tokens(text.normalize(F.col("t"))).alias("k"), F.length(text.cut_at_sentence(F.col("t"))).alias("c"), text.terms(F.col("t")).alias("w")).collect()
    assert [r.n for r in got[:3]] == ["", "", "a b"] and [r.k for r in got[:3]] == [0, 0, 1]
    assert got[3].c == 1201 and got[0].w == []
