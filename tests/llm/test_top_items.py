import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftwell.llm import top_items as ti


def brute(rows, n):
    out = set()
    for g in {r[0] for r in rows}:
        mine = {r for r in rows if r[0] == g and g is not None and r[1] is not None and r[1] == r[1]}
        order = sorted(mine, key=lambda r: (-r[1], r[2] is None, r[2] or datetime.min, r[3] is None, r[3] or 0))
        out |= {(g, i + 1, r[3]) for i, r in enumerate(order[:n])}
    return out


def top(spark, rows, n, types="g long, s long, t timestamp, id long", partitions=3):
    df = spark.createDataFrame(rows, types).withColumn("rank_no", F.lit("clash"))
    got = ti.top_items(df, F.col("g"), F.col("s"), {"t": F.col("t"), "id": F.col("id")}, n, "g", "s", partitions)
    return {(r.g, r.rank_no, r.id) for r in got.collect()}


@pytest.mark.parametrize("n", [1, 3])
def test_equals_brute_force_with_ties_nulls_and_repeats(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 1, *range(20), None]), rng.choice([None, 5, 5, 9, -3, 10**15]), rng.choice([None, datetime(2021, 3, 1), datetime(2021, 3, 2)]), i) for i in range(700)]
    rows += rows[:200]
    assert top(spark, rows, n) == brute(rows, n)


def test_text_groups_double_scores_and_nan(spark):
    rows = [("a", 1.5, None, 1), ("a", float("nan"), None, 2), ("a", -0.5, None, 3), ("b", None, None, 4), (None, 1.0, None, 5)]
    assert top(spark, rows, 5, "g string, s double, t timestamp, id long") == {("a", 1, 1), ("a", 2, 3)}


def test_empty_table(spark):
    assert top(spark, [], 3) == set()


def test_row_groups_below_the_nth_score_are_not_read(tmp_path):
    rows = [(1, s, s % 7) for s in range(1000, 0, -1)] + [(2, s, 0) for s in (9, 8)]
    table = pa.table({"__group": [r[0] for r in rows], "__score": [r[1] for r in rows], "__t0": [r[2] for r in rows]})
    path = tmp_path / "f.parquet"
    pq.write_table(table, path, row_group_size=50)
    steps = list(ti.top_of_file(pq.ParquetFile(path), 3))
    assert sum(skipped for _, skipped in steps) == 19  # of 21: the best one and the one that group 2 shares are read
    best = sorted((r for t, _ in steps if t is not None for r in t.to_pylist()), key=lambda r: (r["__group"], -r["__score"]))
    assert [(r["__group"], r["__score"]) for r in best] == [(1, 1000), (1, 999), (1, 998), (2, 9), (2, 8)]


def test_row_groups_with_an_equal_score_are_read(tmp_path):
    table = pa.table({"__group": [1] * 6, "__score": [5] * 6, "__t0": [6, 5, 4, 3, 2, 1]})
    path = tmp_path / "f.parquet"
    pq.write_table(table, path, row_group_size=2)
    rows = [r for t, _ in ti.top_of_file(pq.ParquetFile(path), 2) if t is not None for r in t.to_pylist()]
    assert [r["__t0"] for r in rows] == [1, 2]


def test_footers_rule_out_the_tail_of_a_hot_group_over_all_files(spark):
    """A group with most rows: of its row groups only those that reach its N-th score are read, in whatever file they lie."""
    df = spark.range(6_000).select(F.when(F.col("id") % 6 > 0, 1).otherwise(F.col("id")).alias("g"), (F.col("id") * 7919 % 6_007).alias("s"))
    report = ti.skipping_report(df, F.col("g"), F.col("s"), {"s2": F.col("s")}, 3, partitions=4, row_group_rows=100).first()
    assert report.n_items == 6_000 and report.row_groups >= 60
    assert report.skipped_by_footer >= 40 and report.read + report.skipped_by_footer + report.skipped_in_file == report.row_groups
    got = ti.top_items(df, F.col("g"), F.col("s"), {"s2": F.col("s")}, 3, partitions=4, row_group_rows=100).where("group = 1")
    best = sorted((i * 7919 % 6_007 for i in range(6_000) if i % 6), reverse=True)[:3]
    assert sorted((r.score for r in got.collect()), reverse=True) == best


def test_an_equal_score_is_never_ruled_out(spark):
    df = spark.range(900).select(F.lit(1).alias("g"), F.lit(5).alias("s"), (900 - F.col("id")).alias("id"))
    assert [r.id for r in ti.top_items(df, F.col("g"), F.col("s"), {"id": F.col("id")}, 2, partitions=3, row_group_rows=50).orderBy("rank_no").collect()] == [1, 2]


def test_stores_by_their_hadoop_names(tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(b"abc")
    assert ti.open_file(f"file:{tmp_path}/x").read() == ti.open_file(f"file://{tmp_path}/x").read() == b"abc"
    asked = []

    def from_uri(uri):
        asked.append(uri)
        return type("S", (), {"open_input_file": lambda self, at: at})(), "k"

    monkeypatch.setattr(ti, "pafs", type("F", (), {"FileSystem": type("G", (), {"from_uri": staticmethod(from_uri)})}))
    assert ti.open_file("s3a://b/k") == "k" and ti.open_file("hdfs://h/k") == "k" and asked == ["s3://b/k", "hdfs://h/k"]
