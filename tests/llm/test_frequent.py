import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwell.llm import frequent


def brute(rows, k, share=0.0):
    ids = {r[0]: r for r in rows}
    out = set()
    for field, i in (("a", 1), ("b", 2)):
        counts = Counter(r[i] for r in ids.values() if r[i] is not None)
        ranked = sorted((x for x in counts.items() if x[1] >= share * len(ids)), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(field, v, n, len(ids)) for v, n in ranked}
    return out


def found(df, k, share=0.0, nodes=None):
    got = frequent.most_frequent(df, F.col("id"), {"a": F.col("a"), "b": F.col("b")}, k, share, nodes)
    return {tuple(r) for r in got.select("field", "item", "n_rows", "of_rows").collect()}


@pytest.mark.parametrize("k,share,nodes", [(1, 0.0, 1), (5, 0.0, 3), (10, 0.05, 8), (1000, 0.0, 4)])
def test_equals_brute_force(spark, k, share, nodes):
    rng = random.Random(k)
    rows = [(i, rng.choice(["hot"] * 30 + ["", None] + [f"v{rng.randrange(300)}" for _ in range(60)]), f"u{rng.randrange(8)}" if rng.random() < 0.3 else f"once{i}") for i in range(600)]
    rows += rows[:150]
    df = spark.createDataFrame(rows, "id long, a string, b string").withColumn("h", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    assert found(df, k, share, nodes) == brute(rows, k, share)


def test_ties_at_the_kth_count_go_to_the_smallest(spark):
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate("ccbbaad")], "id long, a string, b string")
    assert found(df, 2) == {("a", "a", 2, 7), ("a", "b", 2, 7)}


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "id long, a string, b string")
    assert found(df, 3) == set()
    assert found(spark.createDataFrame([(1, None, None)], df.schema), 3) == set()


def test_values_that_share_a_hash_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(frequent.F, "xxhash64", lambda *c: real(*c) % 5)
    rows = [(i, f"v{i % 7}", None) for i in range(100)] + [(i, "v0", None) for i in range(100, 130)]
    got = found(spark.createDataFrame(rows, "id long, a string, b string"), 3, 0.0, 2)
    assert ("a", "v0", 45, 130) in got and len(got) == 3
