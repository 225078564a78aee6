"""Delta algebra: DataFrames whose rows carry a weight in _w (an insert is +1, a delete -1, an update both).

Every operator takes and gives such frames lazily; nothing here starts a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "_w"


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(W, F.lit(weight).cast("bigint"))


def consolidate(df: DataFrame) -> DataFrame:
    """Identical rows added up, weight 0 dropped."""
    columns = [c for c in df.columns if c != W]
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(W, -F.col(W))


def filtered(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def projected(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Narrowed or computed columns; coinciding rows are added up by whatever consolidates next."""
    return df.select(*columns, W)


def joined(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Inner equi-join; weights multiply and NULL keys match nothing. Columns are l.* and r.* prefixed with l_ and r_."""
    a = left.select(*[F.col(f"`{c}`").alias(f"l_{c}") for c in left.columns if c != W], left_key.alias("__lk"), F.col(W).alias("__lw"))
    b = right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns if c != W], right_key.alias("__rk"), F.col(W).alias("__rw"))
    both = a.join(b, F.col("__lk") == F.col("__rk"))
    return both.withColumn(W, F.col("__lw") * F.col("__rw")).drop("__lk", "__rk", "__lw", "__rw")


def delta_join(dr: DataFrame | None, s_old: DataFrame, r_new: DataFrame, ds: DataFrame | None, left_key: Column, right_key: Column) -> DataFrame:
    """Change of R joined with S: dR with the old S, and the new R (dR included) with dS."""
    parts = []
    if dr is not None:
        parts.append(joined(dr, s_old, left_key, right_key))
    if ds is not None:
        parts.append(joined(r_new, ds, left_key, right_key))
    return union(*parts)


def diff_output(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns *old* output rows into *new* ones: -1 for rows gone or changed, +1 for rows new or changed."""
    return consolidate(union(weighted(old, -1), weighted(new, 1)))
