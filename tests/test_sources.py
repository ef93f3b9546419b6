import numpy as np
import pytest

from siltstone.sources import readers, writers
from siltstone.streaming import ingest


def test_lines_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n two \n")
    lines = readers.read_lines(spark, str(tmp_path / "a.txt"))
    assert sorted(r.line for r in lines.collect()) == ["one", "two"]
    writers.write_lines(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_files_inventory_and_index(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.txt").write_bytes(b"word \xff " * 20)
    (tmp_path / "d" / "small.md").write_text("tiny")
    assert readers.read_files(spark, str(tmp_path / "d")).count() == 1
    assert readers.inventory(spark, str(tmp_path / "d")).count() == 2
    (tmp_path / "i.json").write_text('{"records": [{"id": "a", "v": [1, 2]}, {"id": "b", "v": []}]}')
    assert [r.id for r in readers.read_index(spark, str(tmp_path / "i.json"), "id string, v array<double>").orderBy("id").collect()] == ["a", "b"]


def test_vector_shards(spark, tmp_path):
    np.arange(12, dtype="<f4").tofile(tmp_path / "0.f32")
    np.arange(5, dtype="<f4").tofile(tmp_path / "1.f32")
    got = readers.read_vector_shards(spark, str(tmp_path), 4).orderBy("row").collect()
    assert [r.vector for r in got] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_splits_shards_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(i, "val" if i % 4 == 0 else "train") for i in range(20)], "id long, split string")
    writers.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'val'").count() == 5
    writers.write_shards(df, str(tmp_path / "h"), ["id"], 8)
    got = spark.read.json(str(tmp_path / "h")).toPandas()
    assert got.groupby("shard").size().tolist() == [8, 8, 4] and (got["shard"] * 8 + got["row"] == got["id"]).all()
    new = spark.createDataFrame([(3, "new"), (99, "new")], "id long, split string")
    assert {r.id for r in writers.upsert(df, new, "id").filter("split = 'new'").collect()} == {3, 99}
    writers.write_metadata(df.groupBy().count(), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["count"] == 20


def test_text_column(spark):
    assert readers.text_columns(spark.createDataFrame([(1, "a", "b")], "n int, x string, body string")) == ["body"]
    assert readers.text_columns(spark.createDataFrame([(1, "a")], "n int, x string")) == ["x"]
    with pytest.raises(ValueError):
        readers.text_columns(spark.createDataFrame([(1,)], "n int"))


def test_missing_sources(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    assert set(readers.source_streams(spark, str(tmp_path), ("a",), ("b",))) == {"a"}
    with pytest.raises(Exception):
        readers.source_streams(spark, str(tmp_path), ("b",))


def test_ingest_resumes_without_repeating(spark, tmp_path):
    table = tmp_path / "t.parquet"
    schema = "chunk_id string, n int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(str(table))
    for _ in range(2):
        ingest.run_available(ingest.distinct_chunks(ingest.stream_table(spark, str(tmp_path), "t")), str(tmp_path / "out"), str(tmp_path / "c"))
        spark.createDataFrame([("b", 1), ("c", 1)], schema).write.mode("append").parquet(str(table))
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_token_windows_carry_over(spark, tmp_path):
    schema = "stream string, at long, token long"
    table = tmp_path / "t.parquet"
    for start in (0, 7):
        spark.createDataFrame([("s", i, i) for i in range(start, start + 7)], schema).coalesce(1).write.mode("append").parquet(str(table))
        ingest.run_available(ingest.token_windows(ingest.stream_table(spark, str(tmp_path), "t"), 4), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.schema("stream string, start long, inputs array<long>, targets array<long>").parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.start, r.inputs, r.targets) for r in got] == [(s, list(range(s, s + 4)), list(range(s + 1, s + 5))) for s in (0, 4, 8)]
