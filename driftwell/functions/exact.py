"""Exact sums of doubles that merge and retract.

A finite double is an integer times a power of two. Values are added up in buckets of WIDTH binary exponents as
decimal(38,0) integers, which is exact in any order and any grouping and undone by a negative weight; the buckets of a group,
at most 66, are turned into one correctly rounded double in the end. The exponent of x is e = floor(log2 |x|), or one off
where the logarithm rounds; x * 2^(53 - e) is an integer below 2^55 either way. Its bucket is k, the multiple of WIDTH at or
below e, and x * 2^(53 - k) an integer below 2^87: 2^39 rows fit.

Sums of one bucket or of two that are neighbours, which is what values of like size give, are rounded on the JVM side: they
are one decimal, and scaling its nearest double by a power of two is exact outside the subnormal range. Only the rest, and
means of large sums, reach Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Binary exponents of a bucket.
WIDTH = 32


def exponent(x: Column) -> Column:
    """About the binary exponent of a finite double other than 0, else NULL."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & (x != 0)
    return F.when(finite, F.floor(F.log2(F.abs(x))).cast("int"))


def bucket(e: Column) -> Column:
    """The bucket of an exponent."""
    return (F.floor(e / WIDTH) * WIDTH).cast("int")


def mantissa(x: Column, e: Column) -> Column:
    """x * 2^(53 - bucket) as decimal(31,0); the scaling is done in two halves, so that no step overflows."""
    shift = F.lit(53) - e
    half = F.floor(shift / 2).cast("int")
    whole = (x * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (shift - half).cast("double"))).cast("bigint")
    up = F.pow(F.lit(2.0), (e - bucket(e)).cast("double")).cast("bigint")
    return (whole.cast("decimal(20,0)") * up.cast("decimal(11,0)")).cast("decimal(31,0)")


def with_quick(df: DataFrame, name: str, whole: str, buckets: str) -> DataFrame:
    """*df* with *name*: (integer sum + bucket sums) rounded once where that can be done in the JVM, else NULL.

    *buckets* is a sorted array of (k, m). The steps are columns of their own, so that no expression is repeated in the plan.
    """
    at, n = F.col(buckets), F.size(buckets)
    first, second = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    both = F.try_add(F.try_multiply(second["m"], F.lit(1 << WIDTH).cast("decimal(10,0)")), first["m"])
    one = F.when(n == 1, first["m"]).when((n == 2) & (second["k"] - first["k"] == WIDTH), both)
    shift = first["k"] - 53
    half = F.floor(shift / 2).cast("int")
    held, value = F.col("__one"), F.col("__value")
    scaled = held.cast("double") * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (shift - half).cast("double"))
    plain = (held == 0) | ((F.abs(value) > F.lit(2.0**-1000)) & (F.abs(value) < F.lit(float("inf"))))
    found = F.when(n == 0, F.col(whole).cast("double")).when((F.col(whole) == 0) & plain, value)
    return df.withColumn("__one", one).withColumn("__value", scaled).withColumn(name, found).drop("__one", "__value")


def _ratio(numerator: int, shift: int, count: int) -> float:
    """numerator * 2^shift / count, rounded once."""
    if shift >= 0:
        numerator <<= shift
    else:
        count <<= -shift
    try:
        return numerator / count
    except OverflowError:
        return float("inf") if numerator > 0 else float("-inf")


@F.pandas_udf(T.DoubleType())
def rounded(whole: pd.Series, ks: pd.Series, ms: pd.Series, count: pd.Series) -> pd.Series:
    """(integer sum + bucket sums) / count, rounded once; NULL for count 0 or NULL."""
    out = []
    for w, k, m, n in zip(whole, ks, ms, count):
        if n is None or n != n or int(n) == 0:
            out.append(None)
            continue
        total, low = int(w) if w is not None else 0, 0
        parts = [(int(a) - 53, int(b)) for a, b in zip(k, m)] if k is not None else []
        if parts:
            low = min(0, *(s for s, _ in parts)) if len(parts) > 1 else min(0, parts[0][0])
            total = (total << -low) + sum(v << (s - low) for s, v in parts)
        out.append(_ratio(total, low, int(n)))
    return pd.Series(pd.array(out, dtype="Float64"))
