import pytest
from pyspark.sql import functions as F

from driftwell import session


def test_shared_folder_is_read_from_the_session(spark, monkeypatch, tmp_path):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark) == (configured.rstrip("/") if configured else session.shared_folder(spark))

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Fake:
        def __init__(self, value, master):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master, "applicationId": f"other-{master}"})()

    assert session.shared_folder(Fake("hdfs://x/shared/", "yarn")) == "hdfs://x/shared"
    assert session.shared_folder(Fake(None, "local[2]")).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(session.SharedFolderMissing):
            session.shared_folder(Fake(None, master))


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(10)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(session.broadcast_if_small(df, 10)) and not hinted(session.broadcast_if_small(df, 9))
    wide = df.select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert hinted(session.broadcast_if_small(wide, 10, 20_000)) and not hinted(session.broadcast_if_small(wide, 10, 9_000))


def test_written_data_is_read_back(spark):
    df = session.written(spark.range(5).select(F.col("id").alias("x"), F.lit(None).cast("string").alias("y")), "t")
    assert df.count() == 5 and df.columns == ["x", "y"]


def test_the_size_check_takes_one_row_a_task_and_sizes_come_from_files(spark):
    import inspect

    assert ".limit(" not in inspect.getsource(session.broadcast_if_small)
    df = session.written(spark.range(20_000), "sized")
    held = session.input_bytes(df)
    assert 20_000 < held < 400_000 and session.input_bytes(df.groupBy("id").count()) == held
    assert session.partitions_for(df) == session.slots(spark) and session.partitions_for(df, held // 10) >= 10
