import numpy as np
import pytest

from siltstone.llm import leaks
from siltstone.llm.leaks import Lexicon, edits_within, item_matches, leaked_items, least_windows, longest_run, slot_values, split_words, window_length

DOCS = "doc_id long, text string, item_id long, words string"
ITEMS = "item_id long, suite string, lang string, text string, doc_id long"


@pytest.mark.parametrize("templates,words", [(10**6, 10**6), (0, 10**6), (10**6, 4)])
def test_leaks_equal_brute_force(spark, monkeypatch, templates, words):
    """Also with an index too large to send, and with a lexicon too small for most words."""
    monkeypatch.setattr(leaks, "TEMPLATES_IN_TASKS", templates)
    monkeypatch.setattr(leaks, "WORDS_IN_TASKS", words)
    rng = np.random.default_rng(0)
    item = lambda: " ".join(f"{'the' if i % 3 else 'tag'}{rng.integers(30)}" for i in range(int(rng.integers(12, 50))))
    items = [(i, "s", "en", item(), None) for i in range(12)] + [(90, "s", "en", None, None), (91, "s", "en", "", None)]
    words = {i: split_words(t) for i, _, _, t, _ in items if t}
    docs = [(1000, None, 1, "w"), (1001, "", 1, "w"), (1002, "nothing of it here. " * 3000, 1, "w")]
    for d in range(120):
        ws = words[int(rng.integers(12))]
        kind, filler = rng.integers(4), [f"f{rng.integers(50)}" for _ in range(20)]
        if kind == 0:
            at, n = int(rng.integers(0, len(ws))), int(rng.integers(7, 13))
            part = ws[at : at + n]
        elif kind == 1:
            part = list(ws)
            for _ in range(len(ws) // 6 + int(rng.integers(-1, 2))):
                part[int(rng.integers(len(part)))] = f"q{rng.integers(9)}"
        else:
            part = ws if kind == 2 else []
        docs.append((d, " ".join(filler[:10] + [w.upper() + "," for w in part] + filler[10:]), 5, "x"))
    expected = {(d, i) for d, t, _, _ in docs if t for i, ws in words.items() if longest_run(split_words(t), ws, 10) or edits_within(split_words(t), ws) * 6 <= len(ws)}
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(expected) > 40 and got == expected


@pytest.mark.parametrize("docs,items", [([], [(1, "s", "en", "a b c", None)]), ([(1, "a b c", 1, "")], [])])
def test_empty_tables(spark, docs, items):
    assert leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_words_and_slots():
    assert split_words("Hunt<b>ing</b> sup-\nervisor &amp; drive-\nend", {"supervisor": 1}) == ["hunt", "ing", "supervisor", "drive", "end"]
    uses = {w: 3 for w in ("rate", "at")} | {w: 1 for w in ("p", "12", "k", "99", "5", "7", "bar", "mm", "pump")}
    lexicon = Lexicon(uses, 5)
    a, b = (lexicon.windows(lexicon.ids(split_words(t))) for t in ("rate P-12 at 5 bar", "rate K-88 at 6 mm"))
    assert (a[0] == b[0]).all() and (a[1] != b[1]).all()  # one template, other values
    assert (lexicon.windows(lexicon.ids("rate p 12 at bar".split()))[0] != a[0]).all()  # slots are typed


QUESTION = "Suppose pump P-{a} at {x} trips {n} times under {y}; name the seal that the crew at {x} would suspect when {n} alarms come in"


def test_reparameterised_questions(spark):
    fill = lambda **v: QUESTION.format(**({"a": 12, "n": 7, "x": "Vellokor", "y": "Tandun"} | v))
    items = [(i, "s", "en", t, None) for i, t in enumerate((fill(a=900 + i, x=f"Ort{c}", y=f"Lu{c}n", n=60 + i) for i, c in enumerate("abcd")))]
    docs = {1: fill(x="Ostjas", y="Marka"), 2: fill(a=901, x="Ortb", y="Lubn", n=61), 3: fill(x="Ostjas", y="Ostjas"), 4: fill().replace("{x}", "Other", 1).replace("Vellokor", "Other", 1), 5: fill(n="many"), 6: "Suppose pump P-3 at Ulos trips 5 times under Ast. The rest is another text altogether, with words of its own and no end."}
    rows = [(d, f"Intro {d}. {t}. Outro.", 1, "w") for d, t in docs.items()]
    got = {(r.doc_id, r.item_id): r for r in item_matches(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert {k for k, r in got.items() if r.leaks} == {(2, 1)}
    assert {d for (d, _), r in got.items() if not r.leaks} == {1, 2, 5}  # 3 and 4 give one value to two slots or two to one; 5 has a word for two numbers, which is an edit
    assert got[1, 0].alike == len(split_words(fill())) and got[1, 0].other_values == 6 and {i for d, i in got if d == 1} == {0, 1, 2, 3}


def test_slot_values_map_one_to_one():
    lexicon = Lexicon({"at": 9, "from": 9, "1": 1, "2": 1}, 2)
    check = lambda doc, item, shift: slot_values(doc.split(), item.split(), (lexicon.kinds(doc.split()), lexicon.kinds(item.split())), shift)
    assert check("x at 5 from 6 at 5", "at 1 from 2 at 1", 1) == (6, 3, True)
    assert not check("at 5 from 6 at 7", "at 1 from 2 at 1", 0)[2] and not check("at 5 from 5", "at 1 from 2", 0)[2]
    assert check("5 from 6", "at 1 from 2", -1) == (3, 2, True)


def test_bounds():
    assert window_length([38, 60]) == 5 and window_length([6]) == 3 and window_length([]) == 5
    for n in range(10, 120):
        assert least_windows(n, 5) >= 1
    assert edits_within("a b c d".split(), "b x d".split()) == 1 and edits_within([], ["a"]) == 1
