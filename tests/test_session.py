import pytest

from siltstone.session import clear_staged, shared_dir, stage


class Cluster:
    """What shared_dir looks at, of a session on a cluster."""

    class conf:
        values: dict = {}
        get = staticmethod(lambda name, default=None: Cluster.conf.values.get(name, default))

    class sparkContext:
        master = "spark://somewhere:7077"


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    with pytest.raises(RuntimeError):
        shared_dir(Cluster)
    monkeypatch.setattr(Cluster.conf, "values", {"spark.checkpoint.dir": "hdfs://shared"})
    assert shared_dir(Cluster) == "hdfs://shared"


def test_a_local_session_gets_one(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_staged_tables_can_be_cleared(spark):
    clear_staged(spark)
    df = stage(spark.range(10).toDF("n"), "numbers")
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 10 and clear_staged(spark) == 1 and clear_staged(spark) == 0
    with pytest.raises(Exception):
        spark.read.schema("n long").parquet(folder).collect()
