import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwell import session
from driftwell.operators import skew


def brute(rows, percentiles):
    out = {}
    for k in {k for k, _ in rows}:
        vs = sorted(v for q, v in rows if q == k and v is not None)
        counts = Counter(vs)
        mode = min(counts, key=lambda v: (-counts[v], v)) if vs else None
        ps = [vs[max(1, math.ceil(p * len(vs))) - 1] if vs else None for p in percentiles]
        out[k] = (sum(q == k for q, _ in rows), len(vs), sum(vs) if vs else None, len(counts), mode, *ps)
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 2_000_000])
def test_profile_equals_brute_force(spark, block_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(-5, 40)])) for _ in range(600)] + [("nulls", None)] * 3
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["key"]: (r.n_rows, r.n_values, None if r.total is None else int(r.total), r.n_distinct, r["mode"], r.p25, r.p90) for r in skew.key_profile(df, {"key": F.col("k")}, F.col("v"), (0.25, 0.9), block_rows).collect()}
    assert got == brute(rows, (0.25, 0.9))


def test_profile_of_an_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k string, v long, __n long, __value long, n_rows long")
    assert skew.key_profile(df, {"k": F.col("k")}, F.col("v"), (0.5,)).count() == 0
    df = spark.createDataFrame([("x", 1, 7, 8, 9), ("x", 1, 1, 1, 1)], df.schema)
    assert skew.key_profile(df, {"k": F.col("k")}, F.col("v"), (0.5,)).first().asDict() == {"k": "x", "n_rows": 2, "n_values": 2, "total": 2, "n_distinct": 1, "mode": 1, "p50": 1}


def test_total_is_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([("x", 2**63 - 1)] * 3, "k string, v long")
    assert int(skew.key_profile(df, {"k": F.col("k")}, F.col("v")).first()["total"]) == 3 * (2**63 - 1)


def test_heavy_keys_count_null_in_the_total_only(spark):
    rows = [("c", "a")] * 2 + [("c", None)] * 98 + [(None, "b")] * 5
    df = spark.createDataFrame(rows, "cell string, k string").withColumn("v", F.lit(1))
    profile = skew.key_profile(df, {"cell": F.col("cell"), "k": F.col("k")}, F.col("v"))
    assert {(r.cell, r.k, r.scope_rows) for r in skew.heavy_keys(profile, ["cell"], "k", 50).collect()} == {("c", "a", 100), (None, "b", 5)}
    assert skew.heavy_keys(profile, ["cell"], "k", 49).where("cell = 'c'").count() == 0


def test_no_task_gets_the_rows_of_a_hot_key(spark):
    df = spark.range(0, 20_000, numPartitions=4).select(F.lit("hot").alias("k"), (F.col("id") % 50).alias("v"))
    freq = skew.value_frequencies(df, {"k": F.col("k")}, F.col("v"))
    assert freq.count() == 50
    plan = freq._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan  # copies fold before the shuffle


def parts_of(df):
    """Rows of the largest (key, salt) group of a join_skewed plan."""
    return df.groupBy("k", "salt").count().agg(F.max("count")).first()[0]


def test_join_skewed_salts_hot_keys_and_loses_nothing(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") < 3_000, 1).otherwise(F.col("id")).alias("k"))
    weights = session.written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("refs")), "weights")
    lookup = spark.createDataFrame([(1, 3_000, "hot")] + [(i, 1, "cold") for i in range(3_000, 3_010)], "key long, refs long, kind string")
    joined = skew.join_skewed(rows, "k", ["id"], lookup, "key", weights, "k", "refs")
    assert joined.count() == 3_010 and joined.columns == ["id", "k", "key", "refs", "kind"]
    assert joined.where("kind = 'hot'").select("id").distinct().count() == 3_000
    assert skew.join_skewed(rows, "k", ["id"], lookup.limit(0), "key", weights, "k", "refs").count() == 0
    assert skew.join_skewed(rows, "k", ["id"], lookup, "key", weights.limit(0), "k", "refs").count() == 3_010


@pytest.mark.parametrize("healthy", [True, False])
def test_no_join_task_gets_the_rows_of_a_hot_key(spark, healthy):
    """A key with a third of all rows: split where the lookup has it, dropped before the shuffle where not."""
    rows = spark.range(6_000).select("id", F.when(F.col("id") < 2_000, 1).otherwise(F.col("id")).alias("k"))
    weights = session.written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("refs")), "weights")
    lookup = session.written(spark.createDataFrame([(5_000, 1)] if healthy else [(1, 1), (5_000, 1)], "key long, x long"), "lookup")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.join_skewed(rows, "k", ["id"], lookup, "key", weights, "k", "refs", parts=100)
        assert joined.count() == (1 if healthy else 2_001)
        plan = joined._jdf.queryExecution().optimizedPlan()
        assert "Join Inner" in plan.toString()
        side = re.findall(r"pmod\(xxhash64\(id[^)]*\), cast\(__salts", plan.toString())
        assert side
        # the same salts as the plan's: what reaches a task of the shuffle
        salts = -(-2_000 * 100 // 6_000)
        salted = rows.withColumn("salt", F.when(F.col("k") == 1, F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0))
        assert parts_of(salted if not healthy else salted.where("k <> 1")) <= 2 * 6_000 // 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_key_filter_keeps_every_row_of_its_keys(spark):
    rows = session.written(spark.range(3_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), F.lit("x").alias("__word")), "rows").drop("__word")
    keys = spark.createDataFrame([(i,) for i in range(1, 600, 7)] + [(None,)], "key long")
    kept = skew.possibly_in(rows, "k", keys, "key")
    wanted = rows.join(keys, F.col("k") == F.col("key"), "left_semi")
    assert wanted.exceptAll(kept).count() == 0 and wanted.count() <= kept.count() < 200
    assert skew.possibly_in(rows, "k", keys, "key", words=1).exceptAll(rows).count() == 0
    assert skew.possibly_in(rows, "k", keys.limit(0), "key").count() == 0


def test_binary_search_of_blocks(spark):
    rng = random.Random(5)
    for bounds in ([], [3], sorted(rng.sample(range(100), 13)), list(range(0, 64, 2))):
        df = spark.range(-3, 110).withColumn("b", skew._block_of(F.col("id"), bounds))
        assert all(r.b == sum(x < r.id for x in bounds) for r in df.collect())
