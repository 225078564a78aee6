import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.llm import distinct_runs as dr


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_round_trip(values):
    run = np.array(sorted(values), np.uint64)
    assert (dr.decode_run(dr.encode_run(run)) == run).all() and len(dr.decode_run(dr.encode_run(run))) == len(run)


@pytest.mark.parametrize("n", [1, 2, 1000, 100_000])
def test_dense_and_spread_runs(n):
    for run in (np.arange(n, dtype=np.uint64), np.unique(np.random.default_rng(1).integers(0, 2**64, n, np.uint64))):
        data = dr.encode_run(run)
        assert (dr.decode_run(data) == run).all()
    if n == 100_000:
        assert len(data) < 7 * n  # gaps are shorter than 64-bit hashes


def test_union_is_associative_and_idempotent():
    rng = np.random.default_rng(2)
    runs = [np.unique(rng.integers(0, 500, 100).astype(np.uint64)) for _ in range(4)]
    whole = dr.union_runs(runs)
    assert (whole == np.unique(np.concatenate(runs))).all()
    assert (dr.union_runs([dr.union_runs(runs[:2]), dr.union_runs(runs[1:])]) == whole).all()


def brute(rows, at):
    out = {}
    for r in rows:
        for m, i in (("a", 2), ("b", 3)):
            if r[i] is not None:
                out.setdefault((*[r[j] for j in at], m), set()).add(r[i])
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("bits", [0, 3])
def test_counts_equal_brute_force_at_every_level(spark, bits):
    rng = random.Random(4)
    rows = [(rng.choice(["d1", "d2"]), rng.choice(["x", "y", None]), 7 if rng.random() < 0.3 else rng.randrange(200), rng.choice([None, *"pqrs"])) for _ in range(800)]
    df = spark.createDataFrame(rows, "day string, ch string, a long, b string").withColumn("run", F.lit("clash")).repartition(3)
    fine = spark.createDataFrame([(d, c, bits) for d in ("d1", "d2") for c in ("x", None)], "day string, ch string, bits int") if bits else None
    partial = dr.partial_runs(df, {"day": F.col("day"), "ch": F.col("ch")}, {"a": F.col("a"), "b": F.col("b")}, fine, buffer_rows=100)
    merged = dr.merge_runs(partial, ["day", "ch"])
    assert merged.groupBy("day", "ch", "measure", "shard").count().where("count > 1").count() == 0
    got = {(r.day, r.ch, r.measure): r.n_distinct for r in dr.distinct_counts(merged, ["day", "ch"]).collect()}
    assert got == brute(rows, (0, 1))
    coarse = dr.distinct_counts(dr.merge_runs(merged, ["day"], spark.createDataFrame([("d1", bits + 2), ("d2", bits)], "day string, bits int")), ["day"])
    assert {(r.day, r.measure): r.n_distinct for r in coarse.collect()} == brute(rows, (0,))
    assert all(0 <= r.collision_bound < 1e-12 for r in coarse.collect())


def test_partial_results_merge_in_any_order(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") % 120).alias("a"))
    parts = [dr.partial_runs(df.where(F.col("a") % 3 == i), {"g": F.col("g")}, {"a": F.col("a")}) for i in (2, 0, 1)]
    twice = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[0])
    assert dr.distinct_counts(dr.merge_runs(twice, ["g"]), ["g"]).first().n_distinct == 120


def test_empty_table_and_sizes(spark):
    df = spark.createDataFrame([], "g string, a long")
    runs = dr.merge_runs(dr.partial_runs(df, {"g": F.col("g")}, {"a": F.col("a")}), ["g"])
    assert dr.distinct_counts(runs, ["g"]).count() == 0
    sizes = spark.createDataFrame([("a", 100), ("b", 60), ("b", 41), ("c", 1600), ("d", 1601), (None, 1601)], "g string, n long")
    assert {r.g: r.bits for r in dr.shard_bits(sizes, ["g"], capacity=100).collect()} == {"b": 1, "c": 4, "d": 5, None: 5}


def test_a_large_group_does_not_cut_the_others(spark):
    """The runs of the small groups are the same bytes, whatever the size of another group."""
    df = spark.range(4_000).select(F.when(F.col("id") < 3_000, "large").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("g"), F.col("id").alias("a"))
    held = {}
    for factor in (1, 100):
        sizes = df.groupBy("g").agg(F.when(F.col("g") == "large", F.count("*") * factor).otherwise(F.count("*")).alias("n"))
        merged = dr.merge_runs(dr.partial_runs(df, {"g": F.col("g")}, {"a": F.col("a")}, dr.shard_bits(sizes, ["g"], capacity=1_000)), ["g"])
        rows = merged.collect()
        held[factor] = {r.g: bytes(r.run) for r in rows if r.g != "large"}
        assert sum(r.n for r in rows) == 4_000 and all(r.shard == 0 for r in rows if r.g != "large")
    assert held[1] == held[100] and len(held[1]) == 5
