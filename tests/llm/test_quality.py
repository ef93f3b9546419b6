import pandas as pd

from siltstone.llm.examples import EXAMPLES
from siltstone.llm.quality import batch_statistics, document_kinds

SCHEMA = "doc_id long, text string, kind string, n_words long"


def test_examples_get_their_kind(spark):
    rows = [(i, text, "x", 0) for i, (_, _, text) in enumerate(EXAMPLES)] + [(900, None, None, None), (901, "", None, None), (902, " \n", None, None), (903, EXAMPLES[0][2] * 2000, None, None)]
    got = {r.doc_id: r.kind for r in document_kinds(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = [(EXAMPLES[i][:2], got[i]) for i in range(len(EXAMPLES)) if got[i] != EXAMPLES[i][0]]
    assert not wrong
    assert got[900] == got[901] == got[902] == "junk" and got[903] == "prose"


def test_empty_table(spark):
    assert document_kinds(spark.createDataFrame([], SCHEMA)).count() == 0


def test_statistics():
    s = batch_statistics(["The pump is old. It leaks.", None, "a | b | c\nd | e | f", "\U0001f527 ok"])
    assert isinstance(s, pd.DataFrame) and s.n_words.tolist()[:2] == [6, 0]
    assert s.end_share[0] == 1 and s.cell_share[2] == 1 and s.n_lines.tolist() == [1, 0, 2, 1]
