from pathlib import Path

import numpy as np
import pytest

from siltstone.llm.packing import best_fit_decreasing, pack_documents
from siltstone.llm.tokens import TOKENIZER, count_tokens, estimated_tokens, token_budget

DOCS = "doc_id long, text string, lang string, source string, domain string, tokens long"
CHUNKS = "chunk_id string, source string, text string, metadata map<string,string>"
STATS = "run_id long, source string, source_estimated_tokens long"
needs_tokenizer = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="needs the tokenizer file")


def naive(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= s]
        if fits:
            _, i = min(fits)
        else:
            i = len(rooms)
            rooms.append(capacity)
        rooms[i] -= s
        out.append(i)
    return rooms


def test_best_fit_equals_the_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 101, 200).tolist(), reverse=True)
        bins = best_fit_decreasing(sizes, 100)
        rooms = [100] * (max(bins) + 1)
        for s, b in zip(sizes, bins):
            rooms[b] -= s
        assert sorted(rooms) == sorted(naive(sizes, 100)) and min(rooms) >= 0
    assert best_fit_decreasing([], 10) == []


@needs_tokenizer
def test_containers_hold_every_token_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "pump seal " * int(rng.integers(1, 300)), None, None, None, 1) for i in range(200)] + [(900, None, None, None, None, 1), (901, "", None, None, None, 1), (902, "word " * 5000, None, None, None, 1)]
    got = pack_documents(spark.createDataFrame(rows, DOCS), 1024, shard_items=60).toPandas()
    assert got.groupby("container").tokens.sum().max() <= 1024
    sums = got.groupby("doc_id").tokens.sum()
    assert all(sums[i] == count_tokens([t])[0] for i, t, *_ in rows if t) and not {900, 901} & set(got.doc_id)
    split = got.groupby("doc_id").size()
    assert all(n == 1 for d, n in split.items() if sums[d] <= 1024) and split[902] == -(-sums[902] // 1024)
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


@needs_tokenizer
def test_estimates_are_near_the_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {str(r.doc_id): r.text for r in docs.select("doc_id", "text").collect()}
    got = estimated_tokens(docs, spark.createDataFrame([], CHUNKS)).toPandas()
    true = np.array(count_tokens([texts[k] for k in got.key]))
    assert abs(got.tokens.sum() / true.sum() - 1) < 0.03
    assert np.median(np.abs(got.tokens - true) / true) < 0.12


@needs_tokenizer
def test_budget_of_odd_rows(spark):
    docs = [(1, None, "en", None, None, 1), (2, "", None, "a", None, 1), (3, "Die Pumpe ist alt und das Lager wird geprüft.", "xx", "a", "d", 1)]
    chunks = [("c", "f", "some text", {"lang": "en", "domain": "d"}), ("c", "f", "some text", {"lang": "en", "domain": "d"}), (None, "f", "x", None)]
    got = token_budget(spark.createDataFrame(docs, DOCS), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame([(0, "a", None), (1, "a", 12)], STATS)).toPandas()
    assert got.texts.sum() == 4 and got[got.source == "a"].reported_tokens.tolist() == [12.0] * (got.source == "a").sum()
    assert "de" in set(got.lang) and got[got.source.isna()].estimated_tokens.tolist() == [0]
    empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], STATS)
    assert token_budget(*empty).count() == 0


@needs_tokenizer
def test_wrong_codes_yield_to_what_the_text_tells(spark):
    texts = {
        "en": "The pump is old and the bearing was checked by the operator before it had been started.",
        "de": "Die Pumpe ist alt und das Lager wird nach der Prüfung nicht mit dem Motor verbunden.",
        "fr": "La pompe est ancienne et les paliers ne sont pas dans le local pour la visite des moteurs.",
        "es": "La bomba es vieja y los cojinetes se revisan por el operador cuando no está en marcha según el plan.",
        "zh": "LT-101 | 4711 | " * 40 + "泵的轴承已经检查完毕",
    }
    rows = [(f"{true}-{stated}", t, stated, "a", None, 1) for true, t in texts.items() for stated in ("en", "de", "fr", "es", "zh", "EN-us", "xx", None)]
    rows += [("keep-de", "chiller 4711", "de", "a", None, 1), ("keep-zh", "chiller 4711", "zh", "a", None, 1), ("und", "chiller 4711", None, "a", None, 1)]
    docs = spark.createDataFrame(rows, DOCS.replace("doc_id long", "doc_id string"))
    got = {r.key: r.lang for r in estimated_tokens(docs, spark.createDataFrame([], CHUNKS)).collect()}
    assert [k for k, lang in got.items() if k[:2] in texts and lang != k[:2]] == []
    assert (got["keep-de"], got["keep-zh"], got["und"]) == ("de", "zh", "und")
