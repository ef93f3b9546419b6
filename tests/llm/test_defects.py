import numpy as np
import pytest

from siltstone.llm import defects
from siltstone.llm.defects import DEFECTS, EXAMPLES, Vocabulary, example_votes, fit_label_model, pair_defects, pair_labels, posterior, tokens_of, votes_of

SCHEMA = "row_id long, orca_id string, system string, question string, response string, defect string"
SENTENCES = [
    "After {n} cycles the {p} was replaced and the pump returned to service.", "No further leak was seen once the {p} had been tested.",
    "The operator reported {n} bar at the {p}, which is above the limit.", "Do not open the line until the crew has measured the {p}.",
]
PARTS = ["shaft seal", "valve stem", "oil filter", "drive belt", "level gauge"]


def corpus():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        text = " ".join(SENTENCES[rng.integers(4)].format(n=rng.integers(2, 900), p=PARTS[rng.integers(5)]) for _ in range(4))
        rows.append([i, str(i), None, f"Why was the {PARTS[i % 5]} of pump {i} replaced during the night shift?", text, None])
    rows[10][4] = None
    rows[20][4] = "​ \n"
    rows[30][4] = "I'm sorry, but I can't help with that."
    rows[40][4] = rows[40][3].upper()
    rows[50][4] = "Die Pumpe wurde nach dem Regen geprüft, und der Techniker hat keine Leckage gefunden."
    rows[60][4] = rows[60][4].rsplit(" ", 3)[0] + " the"
    rows[70][4] = rows[70][4][:-1]
    rows[80][4] += "\n1. Clean it.\n2."
    rows[90][3] = None
    rows[100][2], rows[100][4] = "Always answer in German.", rows[50][4]
    rows[110][4] = "N/A"
    rows[120][4] = rows[120][4] * 300
    return rows


EXPECTED = {10: "empty", 20: "empty", 30: "refusal", 40: "copies_question", 50: "other_language", 60: "truncated", 80: "truncated", 110: "empty"}


@pytest.mark.parametrize("in_tasks", [10**6, 0])
def test_defects_of_a_small_corpus(spark, monkeypatch, in_tasks):
    """Contexts are counted alike whether the asked ones are sent to the tasks or all are counted and joined."""
    monkeypatch.setattr(defects, "ASKED_IN_TASKS", in_tasks)
    rows = corpus()
    rows += [[1000 + i, *rows[i][1:]] for i in EXPECTED]
    got = {r.row_id: r.defect for r in pair_defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == EXPECTED | {1000 + i: d for i, d in EXPECTED.items()}


@pytest.mark.parametrize("rows", [[], [[1, None, None, None, None, None]], [[1, "a", "s", "Why?", "Because the pump was old.", None]]])
def test_small_tables(spark, rows):
    got = {(r.row_id, r.defect) for r in pair_labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == ({(1, "empty")} if rows and rows[0][4] is None else set())


def test_inspected_examples_get_their_label():
    vocabulary = Vocabulary({w: 9 for w in "the feed pump trips because suction strainer was half closed it should be cleaned every days".split()} | {"#": 900}, 1000)
    rows = [votes_of(vocabulary, *texts) for *texts, _ in EXAMPLES]
    shares = {(i, of): 0.05 if label == "truncated" else 0.98 for i, (*_, label) in enumerate(EXAMPLES) for of in ("contexts", "frames") if label in (None, "truncated")}
    votes, labels = example_votes(rows, shares), [label for *_, label in EXAMPLES]
    for defect in DEFECTS:
        patterns = {}
        for v in map(tuple, votes[defect]):
            patterns[v] = patterns.get(v, 0) + 1
        prior, table = fit_label_model(patterns)
        p = posterior(votes[defect], prior, table)
        truth = np.array([x == defect for x in labels])
        assert p[truth].min() > p[~truth].max(), defect


def test_streams_and_contexts():
    vocabulary = Vocabulary({"the": 500, "pump": 2, "runs": 2}, 10_000)
    texts = [tokens_of(t) for t in ("The pump runs. The seal", "...", "", "runs!! ? the odd odd pump")]
    for frames in (False, True):
        flat, text = vocabulary.stream(texts, frames)
        for i, t in enumerate(texts):
            assert flat[text == i].tolist() == vocabulary.stream([t], frames)[0].tolist()
    assert vocabulary.stream(texts[:1])[0].tolist() == [1, 5, 3, 4, 0, 1, 5, 2]
    assert vocabulary.stream(texts[3:], True)[0].tolist() == [1, 2, 0, 1, 5, 2]
    stream = vocabulary.stream(texts[:1])[0]
    for frames in (False, True):
        assert [h[-1] for h in Vocabulary.contexts(stream, frames)] == defects._context_hashes(stream.tolist(), frames)


def test_forms():
    assert defects.refusal_votes("As an operator you must refuse to start the pump. The seal was old and it had to be replaced before the next shift came in.")[0] == -1
    assert defects.refusal_votes("Lo siento, no puedo ayudar con esa solicitud.")[0] == 1
    assert defects.copy_votes("Why does it leak?", "Question: why does it leak")[0] == 1
    assert defects.language("El operador revisó la bomba y ya no encontró una fuga.") == "es" and defects.language("12 bar") is None
    assert defects.refusal_votes("The pump was old. " * 30 + "I can't help with that.")[1] == 1  # however late it is said
