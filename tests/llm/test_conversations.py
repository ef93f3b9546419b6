import numpy as np
import pytest

from siltstone.llm.conversations import conversation_defects, conversations, least_offsets, ordered_messages, sender_offsets

SCHEMA = "id long, conversation_id string, role string, content string, created_at string, metadata string, at long, turns int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)


def found(spark, rows):
    return {r.conversation_id: r.defect for r in conversation_defects(ordered_messages(frame(spark, rows))).collect()}


def at(minute):
    return f"2026-01-01 {10 + minute // 60:02d}:{minute % 60:02d}:00"


def test_defects(spark):
    talk = lambda c, roles, first=0: [(first + i, c, r, f"text {i}", at(i), None) for i, r in enumerate(roles)]
    rows = talk("good", ["system", " User", "gpt", "tool", "human", "BOT"], 0) + talk("first", ["assistant", "user", "bot"], 100) + talk("twice", ["user", "assistant", "assistant"], 200)
    rows += talk("open", ["user", "assistant", "user"], 300) + talk("strange", ["user", "assistant", "?"], 400) + talk("norole", ["user", "assistant", None], 450)
    rows += [(500, "blank", "user", "  \n", at(0), None), (501, "blank", "tool", "x", at(1), None), (510, None, "user", "x", at(0), None)]
    rows += [(600, "late", "assistant", "b", "2026-01-01T15:35:00+05:30", "{}"), (601, "late", "user", "a", "2026-01-01T10:04:59.5Z", "no json")]
    rows += [(700, "copy", "user", "a", at(0), None), (701, "copy", "assistant", "b", at(1), None), (702, "copy", "bot", "b", "2026-01-01T10:01:00+00:00", None)]
    rows += [(800, "unread", "user", "a", "yesterday", None), (801, "unread", "assistant", "b", None, None)]
    assert found(spark, rows) == {"good": None, "first": "broken", "twice": "broken", "open": "missing_reply", "strange": "broken", "norole": "broken", "blank": "empty", "late": None, "copy": None, "unread": None}
    turns = conversations(frame(spark, rows)).toPandas()
    good = turns[turns.conversation_id == "good"].sort_values("turn")
    assert good.turn.tolist() == [1, 2, 3, 4, 5, 6] and good.role.tolist() == ["system", "user", "assistant", "tool", "user", "assistant"]
    assert set(turns.conversation_id) == {"good", "late", "copy", "unread"} and len(turns[turns.conversation_id == "copy"]) == 2


def test_a_hot_conversation_is_seamless(spark):
    rows = [(i, "hot", "user" if i % 2 == 0 else "assistant", f"t{i}", f"2026-01-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00", None) for i in range(600)]
    rng = np.random.default_rng(0)
    rows = [rows[i] for i in rng.permutation(600)]
    assert found(spark, rows) == {"hot": None}
    assert found(spark, [r for r in rows if r[0] != 301]) == {"hot": "missing_reply"}
    assert found(spark, [r for r in rows if r[0] != 300]) == {"hot": "broken"}
    turns = conversations(frame(spark, rows)).toPandas()
    assert turns.sort_values("turn").content.tolist() == [f"t{i}" for i in range(600)]


def test_clock_offsets():
    offsets, feasible = least_offsets([(1, 0, 60.0)])
    assert feasible and np.allclose(offsets, [-30, 30, 0, 0])
    assert least_offsets([(1, 0, 60.0), (0, 1, -100.0)])[1] and not least_offsets([(1, 0, 60.0), (0, 1, -10.0)])[1]
    assert np.allclose(least_offsets([])[0], 0)


def test_offsets_put_replies_after_what_they_answer(spark):
    rows = [(1, "c", "user", "q1", at(10), None), (2, "c", "assistant", "a1", at(5), '{"reply_to": 1}'), (3, "c", "user", "q2", at(20), None), (4, "c", "assistant", "a2", at(16), '{"reply_to": 3}')]
    assert found(spark, rows) == {"c": None}
    turns = conversations(frame(spark, rows)).toPandas().sort_values("turn")
    assert turns.content.tolist() == ["q1", "a1", "q2", "a2"] and turns.corrected.is_monotonic_increasing and not turns.instant.is_monotonic_increasing
    assert {(r.role, r.offset_s) for r in sender_offsets(frame(spark, rows)).collect()} == {("user", -150.0), ("assistant", 150.0)}
    clash = rows + [(5, "c", "user", "q3", at(3), '{"reply_to": 2}')]
    assert found(spark, clash) == {"c": "broken"}


def test_latencies_move_clocks_but_not_turns(spark):
    second = lambda s: f"2026-01-01 10:00:{s:02d}"
    rows = [(1, "c", "user", "q1", second(0), '{"latency_ms": 9000}'), (2, "c", "assistant", "a1", second(2), '{"latency_ms": 5000}'), (3, "c", "user", "q2", second(30), None), (4, "c", "assistant", "a2", second(40), '{"latency_ms": 4000}')]
    rows += [(11, "wrong", "user", "q1", second(0), None), (12, "wrong", "assistant", "a1", second(2), '{"latency_ms": 50000}'), (13, "wrong", "user", "q2", second(3), None), (14, "wrong", "assistant", "a2", second(40), "{}")]
    assert found(spark, rows) == {"c": None, "wrong": None}
    assert {(r.conversation_id, r.role, round(r.offset_s, 6)) for r in sender_offsets(frame(spark, rows)).collect()} == {("c", "user", -1.5), ("c", "assistant", 1.5)}
    turns = conversations(frame(spark, rows)).toPandas()
    for c in ("c", "wrong"):
        assert turns[turns.conversation_id == c].sort_values("turn").content.tolist() == ["q1", "a1", "q2", "a2"]
    hot = [(i, "hot", "user" if i % 2 == 0 else "assistant", f"t{i}", f"2026-01-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00", '{"latency_ms": 61000}') for i in range(600)]
    assert {(r.role, round(r.offset_s, 6)) for r in sender_offsets(frame(spark, hot)).collect()} == {("user", -0.5), ("assistant", 0.5)}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None)]])
def test_small_tables(spark, rows):
    assert found(spark, rows) == {} and conversations(frame(spark, rows)).count() == 0 and sender_offsets(frame(spark, rows)).count() == 0
