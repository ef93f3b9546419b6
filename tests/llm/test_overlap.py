import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import overlap
from siltstone.llm.overlap import allowed, choose, index_filter, overlap_report, rarest_of_parts, split_overlaps
from siltstone.llm.text import word_distance

SCHEMA = "row_id long, corpus string, source string, split string, text string, key long"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 14))
def test_distance(a, b, most):
    true, got = slow_distance(a, b), word_distance(a, b, most)
    assert got == true if true <= most else got > most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(8, 60), min_size=1, max_size=5), st.integers(0, 1000))
def test_chosen_shingles_are_disjoint(sizes, seed):
    rng, n = np.random.default_rng(seed), np.array(sizes)
    cost = {k: np.where(np.arange(n.max() - k + 1) <= (n - k)[:, None], rng.random((len(n), n.max() - k + 1)), np.inf) for k in (2, 4, 8)}
    text = np.repeat(np.arange(len(n)), 2)
    count = np.array([c for m in sizes for c in (allowed(m) + 1, -(-m // 4))])
    request, start, length = choose(cost, n, text, count)
    for r in range(len(text)):
        mine = request == r
        spans = sorted(zip(start[mine], start[mine] + length[mine]))
        assert len(spans) == count[r] and spans[0][0] >= 0 and spans[-1][1] <= n[text[r]]
        assert all(e <= s for (_, e), (s, _) in zip(spans, spans[1:]))
        parts = sorted((s, s + k) for s, k in rarest_of_parts({k: c[text[r]] for k, c in cost.items()}, int(n[text[r]]), int(count[r])))
        assert len(parts) == count[r] and all(e <= s for (_, e), (s, _) in zip(parts, parts[1:])) and parts[-1][1] <= n[text[r]]


def test_the_filter_holds_every_key(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    known, bits = index_filter(spark.createDataFrame([(int(k),) for k in keys], "h long"))
    assert overlap._passing(keys, known, bits).tolist() == list(range(len(keys)))
    assert np.unpackbits(known).sum() <= 2 * len(keys)


@pytest.mark.parametrize("long_words,in_tasks,full", [(400, 10**6, False), (20, 10**6, False), (400, 0, False), (400, 0, True)])
def test_pairs_equal_brute_force(spark, monkeypatch, long_words, in_tasks, full):
    """Also with every longer text taken as long, with an index too large to send, and with a filter that all shingles pass."""
    monkeypatch.setattr(overlap, "INDEX_IN_TASKS", in_tasks)
    monkeypatch.setattr(overlap, "LONG_WORDS", long_words)
    if full:
        monkeypatch.setattr(overlap, "index_filter", lambda index: (np.full(4096, 255, np.uint8), 15))
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    rows, texts = [], []

    def add(split, ws):
        texts.append((len(texts), split, ws))
        rows.append((len(rows), "openorca", None, split, "<|user|> " + " ".join(ws).title() + "!", 7))

    for n in (1, 3, 5, 6, 7, 9, 10, 12, 16, 21, 33, 50, 101):
        for _ in range(4):
            base = [words[i] for i in rng.integers(0, 40, n)]
            add("val", base)
            for edits in (0, max(0, allowed(n)), allowed(n) + 1, n // 4):
                ws = list(base)
                for _ in range(edits):
                    at, kind = int(rng.integers(0, len(ws) + 1)), rng.integers(3)
                    ws[at : at + (kind != 0)] = [] if kind == 2 and len(ws) > 1 else [f"x{rng.integers(9)}"]
                add(("train", "pretrain", "val")[int(rng.integers(3))], ws)
    rows += [(9001, None, None, "val", None, 1), (9002, None, None, "train", "", 1), (9003, None, None, None, "w1 w2", 1), (9004, None, None, "val", " ... ", 1)]
    expected = {
        (i, j) for i, s, a in texts if s == "val" for j, t, b in texts if t != "val" and slow_distance(a, b) * 5 < max(len(a), len(b))
    }
    got = {(r.val_row, r.train_row) for r in split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(expected) > 50 and got == expected
    total = overlap_report(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert total["pairs"].sum() == len(expected) and total["exact_pairs"].sum() == sum(texts[i][2] == texts[j][2] for i, j in expected)


def test_empty_table(spark):
    assert split_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0
