"""Base tables as a snapshot and an append-only log of weighted changes.

A table is its snapshot (rows with weights, as of a log position) and the log segments after it. Every append is one segment
with the next position; positions are never used again. Readers choose a position and see the table as of it.

The snapshot lies in hash buckets of the columns in "by": the first unique key, or all columns where there is none. A row
that is removed or replaced names its bucket, so only those buckets are read to find it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import values
from driftwell.operators.zset import W, consolidate, union
from driftwell.plans.errors import IllegalChange
from driftwell.session import broadcast_if_small


def fingerprint(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


def schema_of(meta: dict) -> T.StructType:
    import json

    return T.StructType.fromJson(json.loads(meta["schema"]))


def stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields] + [T.StructField(W, T.LongType())])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """*df* with the table's columns, types and cleaned values, and its weight (1 where it has none)."""
    names = {c.lower(): c for c in df.columns if c != W}
    missing = [f.name for f in schema.fields if f.name.lower() not in names]
    extra = [c for n, c in names.items() if n not in {f.name.lower() for f in schema.fields}]
    if missing or extra:
        raise IllegalChange(f"the rows don't fit the table: missing {missing}, unknown {extra}")
    columns = [values.clean(F.col(f"`{names[f.name.lower()]}`").cast(f.dataType), values.kind_of(f.dataType)).alias(f.name) for f in schema.fields]
    weight = F.col(W).cast("bigint") if W in df.columns else F.lit(1).cast("bigint")
    return df.select(*columns, weight.alias(W))


def read(spark: SparkSession, meta: dict, paths: list[str]) -> DataFrame:
    schema = stored_schema(schema_of(meta))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_of(meta: dict, columns: list[Column] | None = None) -> Column:
    """The snapshot bucket of a row; *columns* stand for the canonical values of the key where given."""
    kinds = {f.name: values.kind_of(f.dataType) for f in schema_of(meta).fields}
    own = columns or [values.canonical(F.col(f"`{c}`"), kinds[c]) for c in meta["by"]]
    return F.pmod(F.xxhash64(*own), F.lit(meta["buckets"])).cast("int")


def as_of(spark: SparkSession, meta: dict, position: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Weighted rows of the table as of *position*, by default now; weights of one row may lie in several places.

    *buckets* leaves out other buckets of the snapshot; the log, which is folded away from time to time, is read whole.
    """
    held = [p for b, p in (meta["snapshot"] or {}).items() if buckets is None or int(b) in buckets]
    return read(spark, meta, held + [p for n, p in meta["segments"] if position is None or n <= position])


def head(meta: dict) -> int:
    return meta["next"] - 1


def changes(spark: SparkSession, meta: dict, after: int, upto: int | None = None) -> DataFrame | None:
    """Log rows after a position, None if there are none."""
    paths = [p for n, p in meta["segments"] if n > after and (upto is None or n <= upto)]
    return read(spark, meta, paths) if paths else None


def _row_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != W]))


def missing_rows(spark: SparkSession, meta: dict, delta: DataFrame, buckets: list[int] | None = None, few: bool = False) -> DataFrame:
    """Rows whose weight would fall below 0 if *delta*, written data of *buckets*, were applied now; *few* says it is small enough to broadcast."""
    removed = _row_hash(delta.where(F.col(W) < 0)).select("__h").distinct()
    there = _row_hash(union(as_of(spark, meta, buckets=buckets), delta)).join(F.broadcast(removed) if few else removed, "__h", "left_semi").drop("__h")
    return consolidate(there).where(F.col(W) < 0)


def unique_keys(meta: dict, key: list[str], rows: DataFrame) -> DataFrame:
    """The values of a unique key among *rows*, as __n0.., each as often as it is there; NULL is no key."""
    kinds = {f.name: values.kind_of(f.dataType) for f in schema_of(meta).fields}
    given = rows.select(*[values.join_key(F.col(f"`{c}`"), kinds[c]).alias(f"__n{i}") for i, c in enumerate(key)])
    for c in given.columns:
        given = given.where(F.col(c).isNotNull())
    return given


def replaced_rows(spark: SparkSession, meta: dict, rows: DataFrame) -> DataFrame:
    """Live rows that share a unique key (NULL shares nothing) with *rows*, with weight -1; a row hit by two keys once.

    Rows that share the key the snapshot lies by are looked for in their buckets only.
    """
    hits = None
    kinds = {f.name: values.kind_of(f.dataType) for f in schema_of(meta).fields}
    for key in meta["unique"]:
        given = unique_keys(meta, key, rows).distinct()
        buckets = None
        if key == meta["by"]:  # there are no more bucket numbers than buckets
            buckets = [r[0] for r in given.select(bucket_of(meta, [F.col(c) for c in given.columns])).distinct().collect()]
        held = as_of(spark, meta, buckets=buckets)
        same = [values.join_key(F.col(f"`{c}`"), kinds[c]) == F.col(f"__n{i}") for i, c in enumerate(key)]
        found = consolidate(held.join(broadcast_if_small(given), same, "left_semi"))  # only rows with such a key are shuffled
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        raise IllegalChange("replace needs a table with a unique key")
    return hits.distinct().withColumn(W, -F.col(W))
