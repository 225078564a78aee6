from driftwell.engine import Engine
from driftwell.streaming.adapter import capture


def test_capture_takes_each_batch_once(spark, tmp_path):
    schema = "k string, v long"
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    engine = Engine(spark, buckets=2)
    engine.create_table("t", spark.createDataFrame([], schema).schema)
    engine.create_view("w", "SELECT k, COUNT(*) AS n, SUM(v) AS s FROM t GROUP BY k")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        capture(engine, "t", stream, checkpoint, ["w"]).awaitTermination()
        return sorted(map(tuple, engine.table("w").collect()))

    spark.createDataFrame([("a", 1), ("b", 2)], schema).coalesce(1).write.parquet(source)
    assert run() == [("a", 1, 1), ("b", 1, 2)]
    assert run() == [("a", 1, 1), ("b", 1, 2)]
    spark.createDataFrame([("a", 5)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == [("a", 2, 6), ("b", 1, 2)]
    position = engine.apply("t", spark.createDataFrame([("a", 5)], schema), batch=("capture", 0))  # a repeated batch
    assert position == 2 and engine.refresh("w") is False
