import pytest
from pyspark.sql import functions as F

from siltstone.functions import templates
from siltstone.operators.chunking import chunks_by
from siltstone.operators.lexical import rare_first_matches
from siltstone.operators.ranking import positions
from siltstone.sources import index, writers
from siltstone.streaming import ingest


def test_templates(spark):
    df = spark.createDataFrame([([("user", " a \n b"), (None, "c"), ("bot", "  ")], "K-1", "", "worn  seal", "replace it"), (None, None, None, None, "x"), ([], "", "PM", "leak", None)], "m array<struct<role string, content string>>, e string, o string, d string, r string")
    got = df.select(templates.chat_text(F.col("m")).alias("chat"), templates.answered_chat_text(F.col("m"), F.col("r")).alias("answered"), templates.work_order_text(F.col("e"), F.col("o"), F.col("d"), F.col("r")).alias("order"), templates.question_text(F.col("o"), F.col("d"), F.col("r")).alias("question")).collect()
    assert got[0].chat == "<|user|> a b <|user|> c" and got[0].answered == "<|user|> a b <|user|> c <|assistant|> replace it"
    assert got[0].order == "<|user|> Create a safe maintenance work instruction. Equipment: K-1. Issue: worn seal <|assistant|> replace it"
    assert got[0].question.startswith("<|system|> You are a helpful assistant. <|user|> worn seal")
    assert all(r.answered == r.order == r.question == "" for r in got[1:])
    none = spark.createDataFrame([("d", "o")], "d string, o string").select(templates.work_order_text(F.lit(None), F.lit(""), F.col("d"), F.col("o")).alias("t")).first().t
    assert "instruction.  Issue" in none  # two blanks where there is no context


def test_index_and_shards(spark, tmp_path):
    assert index.load_index(spark, str(tmp_path / "none"), "id long").count() == 0
    assert index.index_status(spark, str(tmp_path / "none")) == (False, 0, 0)
    rows = spark.createDataFrame([(i, f"text {i}", [float(i), 1.0]) for i in range(25)], "id long, text string, embedding array<double>")
    index.write_knowledge(rows, str(tmp_path / "k"), ["id"], 10)
    assert index.index_status(spark, str(tmp_path / "k")) == (True, 25, 2)
    vectors = {(r.shard, r.row): r.embedding[0] for r in index.read_vectors(spark, str(tmp_path / "k")).collect()}
    assert vectors == {(i // 10, i % 10): float(i) for i in range(25)}
    picked = spark.createDataFrame([(0, 3), (2, 4), (9, 9)], "shard int, row int")
    assert {(r.id, r.text) for r in index.read_picked(spark, str(tmp_path / "k"), "id long, text string", picked).collect()} == {(3, "text 3"), (24, "text 24")}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_rare_first_equals_brute_force(spark, monkeypatch, broadcast):
    from siltstone.operators import lexical

    monkeypatch.setattr(lexical.small_enough, "__defaults__", (broadcast,))
    docs = [(d, [f"t{k}" for k in range(30) if (d * 7 + k * k) % (k + 2) == 0] + ["all"]) for d in range(80)] + [(500, []), (501, None)]
    items = [(i, [f"t{k}" for k in range(i, i + 9)] + ["all"]) for i in range(12)] + [(90, []), (91, ["none"])]
    got = rare_first_matches(spark.createDataFrame(docs, "doc_id long, terms array<string>"), spark.createDataFrame(items, "item_id long, terms array<string>"), 3).collect()
    found = {(r.item_id, r.doc_id): r.matched for r in got}
    for i, t in items[:12]:
        true = {d: len(set(t) & set(w or [])) for d, w in docs}
        best = sorted((d for d in true if true[d]), key=lambda d: (-true[d], d))[:3]
        assert sorted((d for (j, d) in found if j == i), key=lambda d: (-found[i, d], d))[:3] == best
        assert all(found[i, d] == true[d] for j, d in found if j == i)
    assert not {i for i, _ in found} & {90, 91}


def test_least_before(spark):
    df = spark.createDataFrame([("a", i, (i * 37) % 23) for i in range(60)] + [("b", 1, None), ("b", 2, 5)], "k string, at int, v int")
    got = positions(df, ["at"], ["k"], least={"best": F.col("v")}).toPandas().sort_values(["k", "at"])
    a = got[got.k == "a"]
    assert a.best.isna().tolist()[0] and a.best.tolist()[1:] == a.v.cummin().tolist()[:-1]
    assert got[got.k == "b"].best.isna().all()


def test_a_stream_forgets_old_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:05:00"), ("b", "2026-01-01 00:01:00")], "chunk_id string, at string")
    rows.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("chunk_id string, at string").json(str(tmp_path / "in")).withColumn("at", F.col("at").cast("timestamp"))
    ingest.run_available(ingest.distinct_chunks(stream, "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_a_resumed_run_keeps_its_config(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a",)], "chunk_id string").write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("chunk_id string").json(str(tmp_path / "in"))
    for _ in range(2):
        ingest.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"), config={"chunk_tokens": 384})
    with pytest.raises(ValueError):
        ingest.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"), config={"chunk_tokens": 100})
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_writers_and_strategies(spark, tmp_path):
    df = spark.createDataFrame([(1, "  one. two  ", "x"), (2, " \n ", "y"), (3, None, "z")], "doc_id long, text string, other string")
    for _ in range(2):
        writers.write_subset(df, ["doc_id", "other"], str(tmp_path / "s"))
        writers.append_rows(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "s")).columns == ["doc_id", "other"] and spark.read.parquet(str(tmp_path / "s")).count() == 3
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6
    for strategy in ("sentence", "fixed"):
        assert [r.chunk for r in chunks_by(df, strategy).filter("chunk_no = 0").collect()] == ["one. two"]
    with pytest.raises(ValueError):
        chunks_by(df, "other")
