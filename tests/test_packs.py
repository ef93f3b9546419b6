from pathlib import Path

import pandas as pd
import pytest

from siltstone.functions.tokenizer import TOKENIZER, decode, encode
from siltstone.plans import queries

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists() or not Path(TOKENIZER).exists(), reason="needs the test tables")


@needs_data
def test_round_trip(spark):
    texts = pd.Series(["pump 漢字 é", "", None, "<|endoftext|> x"])
    assert decode(encode(texts)).tolist() == ["pump 漢字 é", "", "", "<|endoftext|> x"]
    assert queries()["bpe_encode"](spark, DATA).filter("not round_trip").count() == 0


@needs_data
def test_hybrid_takes_the_best_of_both(spark):
    got = queries()["hybrid_search"](spark, DATA).toPandas()
    assert (got.groupby("item_id").size() == 3).all() and set(got.branch) <= {"dense", "lexical"}
    assert all(part.sort_values("rank").score.is_monotonic_decreasing for _, part in got.groupby("item_id"))


@needs_data
def test_text_top_k_finds_each_query_first(spark):
    got = queries()["text_top_k"](spark, DATA).toPandas()
    best = got[got["rank"] == 1]
    assert (best.score > 0.999).all() and len(best) == got.query_id.nunique()
