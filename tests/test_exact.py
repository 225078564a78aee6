import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from driftwell.functions import exact

INF = float("inf")


def bucketed(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("e", exact.exponent(F.col("x")))
    return df.withColumn("k", exact.bucket(F.col("e"))).withColumn("m", exact.mantissa(F.col("x"), F.col("e")))


def engine_sum(spark, xs, count=None):
    parts = bucketed(spark, xs).where("k is not null").groupBy("k").agg(F.sum("m").cast("decimal(38,0)").alias("m"))
    one = parts.agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("b"))
    none = F.lit(None).cast("decimal(38,0)")
    one = exact.with_quick(one.withColumn("w", F.lit(0).cast("decimal(38,0)")), "q", "w", "b")
    row = one.select(exact.rounded(none, F.col("b.k"), F.col("b.m"), F.lit(count or 1).cast("long")).alias("r"), "q").first()
    assert count or row.q is None or row.q == row.r  # where the JVM rounds, it rounds the same
    return row.r


POOL = [0.1, 0.2, 0.3, -0.1, 1e308, -1e308, 5e-324, -5e-324, 2.0**-1022, 2.0**53, 2.0**53 + 2, 1e15 + 0.5, 1 / 3, 0.0, -0.0, 1.0, 2.0, 4.0, math.nextafter(4, 0), math.nextafter(8, 9), 1.7976931348623157e308]


def once(x):
    try:
        return float(x)
    except OverflowError:
        return INF if x > 0 else -INF


@pytest.mark.parametrize("seed", range(4))
def test_sum_is_rounded_once(spark, seed):
    rng = random.Random(seed)
    xs = [rng.choice(POOL[:-1]) if rng.random() < 0.5 else rng.uniform(-1, 1) * 2.0 ** rng.randrange(-60, 60) for _ in range(200)]
    assert engine_sum(spark, xs) == once(sum(map(Fraction, xs)))


def test_every_power_of_two_and_its_neighbours(spark):
    xs = [y for e in range(-1074, 1024, 13) for x in (2.0**e,) for y in (x, math.nextafter(x, 0), math.nextafter(x, INF), -x * 1.5 if x < 1e308 else x)]
    df = bucketed(spark, xs)
    for r in df.collect():
        if r.x:
            assert Fraction(r.m) * Fraction(2) ** (r.k - 53) == Fraction(r.x)


def test_average_overflow_and_empty(spark):
    assert engine_sum(spark, [0.1, 0.2, 0.3], 3) == 0.2
    assert engine_sum(spark, [1.7976931348623157e308] * 2) == INF
    assert engine_sum(spark, [1.7976931348623157e308] * 2, 2) == 1.7976931348623157e308
    assert engine_sum(spark, [0.0]) == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_like_sized_values_are_rounded_in_the_jvm(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice([1, -1]) * rng.uniform(0.01, 1e5)) for g in range(40) for _ in range(rng.randrange(1, 60))] + [(100, 2.0**31 * 1.1), (100, 2.0**33 * 1.7), (101, 5e-324), (102, 1e300), (102, 1e-300)]
    df = spark.createDataFrame(rows, "g int, x double").withColumn("e", exact.exponent(F.col("x"))).withColumn("k", exact.bucket(F.col("e"))).withColumn("m", exact.mantissa(F.col("x"), F.col("e")))
    parts = df.groupBy("g", "k").agg(F.sum("m").cast("decimal(38,0)").alias("m")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("b"))
    got = {r.g: r.q for r in exact.with_quick(parts.withColumn("w", F.lit(0).cast("decimal(38,0)")), "q", "w", "b").collect()}
    assert got[101] is None and got[102] is None
    for g in set(got) - {101, 102}:
        assert got[g] == float(sum(Fraction(x) for h, x in rows if h == g))
