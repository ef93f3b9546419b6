import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm.splitting import cohesion_depths, split_chunks, split_text

SCHEMA = "chunk_id string, source string, text string, char_start int, char_end int, metadata map<string,string>, piece int"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!?\n漢字，。é1|", max_size=900), st.integers(20, 120))
def test_pieces_cover_and_overlap(t, limit):
    overlap = limit // 5
    pieces = split_text(t, limit, overlap)
    assert all(0 < e - s <= limit for s, e in pieces)
    if t:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    for (_, end), (start, _) in zip(pieces, pieces[1:]):
        assert end - start == overlap


def test_cuts_where_the_topic_changes():
    pumps = "The pump runs on the shaft seal pump. The pump shaft and the pump seal are old. Pump seal and shaft. "
    tanks = "A tank holds crude oil level. Crude oil fills a tank to its level. Tank level of crude oil. "
    t = pumps + tanks + tanks
    spans = split_text(t, 200, 20)
    assert spans[0][1] == len(pumps)
    assert cohesion_depths("", []).size == 0


def test_ends_at_words_where_there_are_no_sentences():
    t = "word " * 300
    assert all(t[e - 1] == " " for _, e in split_text(t, 100, 20)[:-1])
    assert all(e - s == 100 for s, e in split_text("x" * 1000, 100, 20)[:-1])
    with pytest.raises(ValueError):
        split_text("x", 10, 10)


def test_chunks(spark):
    body = " ".join(f"Sentence number {i} tells of seal {i % 7}." for i in range(40))
    file = body + body
    meta = lambda k: {"document_chunk": str(k)}
    rows = [
        ("f_chunk0000", "f", file[:300], 0, 300, meta(0), 9),
        ("f_chunk0001", "f", file[220:1000], None, None, meta(1), 9),
        ("f_chunk0001", "f", file[220:1000], None, None, meta(1), 9),
        ("f_chunk0002", "f", "  \n" + file[920:1500].strip() + "\t ", 0, 0, meta(2), 9),
        ("g", "g", None, 0, 0, None, None), ("h", "h", " \n\t", 0, 3, None, None), ("i", "i", "x" * 401, 5, 406, None, None),
        (None, "j", "text", 0, 4, None, None),
    ]
    got = split_chunks(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert set(got[got.n_pieces > 1].chunk_id) == {"f_chunk0001", "f_chunk0002", "i"}
    assert not got.duplicated(["chunk_id", "piece"]).any() and (got.text.str.len() <= 400).all()
    known = got[(got.source == "f") & (got.chunk_id != "f_chunk0002")]
    assert len(known) and all(file[r.char_start : r.char_end] == r.text for r in known.itertuples())
    assert split_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
