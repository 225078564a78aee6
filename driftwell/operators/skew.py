"""Per-key results without a task that holds the rows of a hot key.

Value-frequency compression: rows are first counted by (key, value), where partial aggregation in the map tasks already
folds the copies, and everything per key then comes from the weighted values. What reaches the task of a key is at most
one partial row per map task, never the key's rows.

Exact percentiles need the values of a key in order. Keys of few distinct values are ordered as a whole, each in one task.
Which keys may have many is known from a count of the frequency rows by a hash of the key: that bound is never too low.
Their values are cut into blocks at boundaries taken from the data, as many as the data needs; only block totals are
ordered per key, and only the one block that holds a percentile is ordered by value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.session import broadcast_if_small, written

_V, _N = "__value", "__n"
#: Rows of which one key's share of the scope is looked up per salt; see with_scope_total.
SCOPE_SALTS = 32
#: Frequency rows of a key, and of a block of a key, that one task puts in order.
BLOCK_ROWS = 2_000_000
#: Hash buckets by which frequency rows are counted to bound the rows of each key.
KEY_BUCKETS = 1 << 16
#: Words of 64 bits in a key filter.
FILTER_WORDS = 1 << 20


def _keyed(df: DataFrame, keys: dict[str, Column], value: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Only the key columns, as __k0.., and the value: no name of the input can clash."""
    names = [f"__k{i}" for i in range(len(keys))]
    columns = [c.alias(n) for n, c in zip(names, keys.values())]
    return df.select(*columns, *([] if value is None else [value.alias(_V)])), names


def value_frequencies(df: DataFrame, keys: dict[str, Column], value: Column) -> DataFrame:
    """One row per key and value with its count: columns __k0.., __value, __n. NULL keys and values are kept as such."""
    rows, names = _keyed(df, keys, value)
    return rows.groupBy(*names, _V).agg(F.count(F.lit(1)).alias(_N))


def _weighted_total(value_type: T.DataType) -> Column:
    if isinstance(value_type, T.FractionalType) and not isinstance(value_type, T.DecimalType):
        return F.sum(F.col(_V) * F.col(_N))
    return F.sum(F.col(_V).cast("decimal(20,0)") * F.col(_N).cast("decimal(18,0)")).cast("decimal(38,0)")


def _profile(kind: T.DataType) -> list[Column]:
    return [
        F.sum(_N).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(_V).isNotNull(), F.col(_N))), F.lit(0)).alias("n_values"),
        _weighted_total(kind).alias("total"),
        F.count(_V).alias("n_distinct"),
        F.min(F.when(F.col(_V).isNotNull(), F.struct((-F.col(_N)).alias("n"), F.col(_V).alias("v"))))["v"].alias("mode"),
    ]


def key_profile(df: DataFrame, keys: dict[str, Column], value: Column, percentiles: Sequence[float] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per key: n_rows, n_values (not NULL), total, n_distinct, mode and, for each of *percentiles*, p50, p90, ...

    total is exact for integers (decimal(38,0)). mode is the most frequent value, of several the smallest. A percentile p is
    the smallest value with at least p of the key's non-NULL values at or below it (nearest rank, exact).
    NULL keys form a group of their own; a key without values has NULL total, mode and percentiles; an empty table gives no row.
    Columns of *df* that are not named in *keys* or *value* play no part, whatever their names.
    """
    freq = value_frequencies(df, keys, value)
    kind = freq.schema[_V].dataType
    names = [f"__k{i}" for i in range(len(keys))]
    if not percentiles:
        return freq.groupBy(*names).agg(*_profile(kind)).withColumnsRenamed(dict(zip(names, keys)))
    freq = written(freq, "frequencies").withColumn("__kb", F.pmod(F.xxhash64(*names), F.lit(KEY_BUCKETS)))
    per_bucket = freq.groupBy("__kb").agg(F.count(F.lit(1)).alias("n"))
    wide = F.broadcast(written(per_bucket.where(F.col("n") > block_rows).select("__kb"), "wide_keys"))  # at most KEY_BUCKETS rows
    narrow, wide = freq.join(wide, "__kb", "left_anti"), freq.join(wide, "__kb", "left_semi")
    found = _narrow_profile(narrow, names, kind, list(percentiles))
    if wide.limit(1).count():
        per_key = wide.groupBy(*names).agg(*_profile(kind))
        picked = _percentiles(wide, names, list(percentiles), block_rows)
        both = per_key.alias("a").join(picked.alias("b"), [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names], "left")
        found = found.unionByName(both.select("a.*", *[f"b.{_percentile_name(p)}" for p in percentiles]))
    return found.withColumnsRenamed(dict(zip(names, keys)))


def _percentile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def _rank(p: float, count: Column) -> Column:
    return F.greatest(F.ceil(F.lit(float(p)) * count).cast("long"), F.lit(1))


def _narrow_profile(freq: DataFrame, names: list[str], kind: T.DataType, wanted: list[float]) -> DataFrame:
    """Everything per key from one shuffle by key: each key's frequency rows fit a task."""
    valued = F.when(F.col(_V).isNotNull(), F.col(_N))
    upto = F.sum(valued).over(Window.partitionBy(*names).orderBy(_V).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = freq.withColumn("__upto", upto).withColumn("__all", F.sum(valued).over(Window.partitionBy(*names)))
    hits = lambda p: (_rank(p, F.col("__all")) <= F.col("__upto")) & (_rank(p, F.col("__all")) > F.col("__upto") - F.col(_N))
    return ordered.groupBy(*names).agg(*_profile(kind), *[F.max(F.when(F.col(_V).isNotNull() & hits(p), F.col(_V))).alias(_percentile_name(p)) for p in wanted])


def _block_of(column: Column, bounds: list) -> Column:
    """How many of the sorted *bounds* lie below *column*, by binary search."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    inside = lambda at, s: (at + s <= len(bounds)) & (F.get(held, F.least(at + s, F.lit(len(bounds))) - 1) < column)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(inside(at, s), at + s).otherwise(at))


def _percentiles(freq: DataFrame, names: list[str], wanted: list[float], block_rows: int) -> DataFrame:
    """Percentiles of keys with many values, from written frequency rows: blocks hold at most about *block_rows* rows of all keys together."""
    valued = freq.where(F.col(_V).isNotNull())
    blocks = max(1, math.ceil(valued.count() / block_rows))
    cut = [i / blocks for i in range(1, blocks)]
    found = valued.agg(F.percentile_approx(_V, cut, max(10_000, 10 * blocks))).first()[0] if cut else []
    weighed = valued.withColumn("__block", _block_of(F.col(_V), sorted(set(found or []))))
    per_block = weighed.groupBy(*names, "__block").agg(F.sum(_N).alias("__bn"))
    running = Window.partitionBy(*names).orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*names)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), _rank(p, F.col("__all")).alias("r")) for i, p in enumerate(wanted)])
    picks = (
        per_block.withColumn("__upto", F.sum("__bn").over(running))
        .withColumn("__all", F.sum("__bn").over(whole))
        .select(*names, "__block", "__bn", "__upto", F.explode(ranks).alias("__p"))
        .where((F.col("__p.r") <= F.col("__upto")) & (F.col("__p.r") > F.col("__upto") - F.col("__bn")))
        .groupBy(*names, "__block")
        .agg(F.collect_list(F.struct(F.col("__p.i").alias("i"), (F.col("__p.r") - F.col("__upto") + F.col("__bn")).alias("at"))).alias("__wanted"))
    )
    picks = broadcast_if_small(written(picks, "picked_blocks"))
    same = [F.col(f"o.{n}").eqNullSafe(F.col(f"p.{n}")) for n in names] + [F.col("o.__block") == F.col("p.__block")]
    kept = weighed.alias("o").join(picks.alias("p"), same).select("o.*", "p.__wanted")  # only blocks that hold a percentile are put in order
    inside = Window.partitionBy(*names, "__block").orderBy(_V).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = kept.withColumn("__cum", F.sum(_N).over(inside)).select(*names, _V, _N, "__cum", F.explode("__wanted").alias("__w"))
    hit = hit.where((F.col("__w.at") <= F.col("__cum")) & (F.col("__w.at") > F.col("__cum") - F.col(_N)))
    return hit.groupBy(*names).agg(*[F.max(F.when(F.col("__w.i") == i, F.col(_V))).alias(_percentile_name(p)) for i, p in enumerate(wanted)])


def with_scope_total(per_key: DataFrame, scope: list[str], count: str, name: str) -> DataFrame:
    """*per_key* with the sum of *count* over all rows of the same *scope* (NULL is a scope of its own) as *name*.

    The totals are repeated over SCOPE_SALTS salts and joined by scope and salt, so that a scope with most keys does not
    fill one task even when the join is shuffled. *per_key* is read twice: it should be written data.
    """
    salted = per_key.withColumn("__salt", F.pmod(F.xxhash64(*per_key.columns), F.lit(SCOPE_SALTS)).cast("int"))
    totals = (
        per_key.groupBy(*[F.col(c).alias(f"__s_{c}") for c in scope])
        .agg(F.sum(count).alias(name))
        .withColumn("__t_salt", F.explode(F.sequence(F.lit(0), F.lit(SCOPE_SALTS - 1))))
    )
    same = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in scope] + [F.col("__salt") == F.col("__t_salt")]
    return salted.join(totals, same).select(*per_key.columns, name)


def heavy_keys(profile: DataFrame, scope: list[str], key: str, one_in: int = 50) -> DataFrame:
    """Keys of a key_profile that hold at least 1/*one_in* of the rows of their scope: scope, key, n_rows, scope_rows.

    Rows without key count in the total only. The counts per key are written once, and nothing else of the profile is computed.
    """
    counts = written(profile.select(*scope, key, "n_rows"), "key_counts")
    whole = with_scope_total(counts, scope, "n_rows", "scope_rows")
    return whole.where(F.col(key).isNotNull() & (F.col("n_rows") * one_in >= F.col("scope_rows")))


def possibly_in(rows: DataFrame, key: str, keys: DataFrame, keys_key: str, words: int = FILTER_WORDS) -> DataFrame:
    """*rows* without most of those whose *key* is none of *keys*; every row whose key is one of them stays, NULL goes.

    Each key sets one of 64 * *words* bits. The words with a set bit are a table of two numbers, at most *words* rows
    whatever the data: that bound is what allows them to be broadcast.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} & 63 AS INT))")
    set_bits = keys.where(F.col(keys_key).isNotNull()).select(place(keys_key).alias("__at")).select(F.expr("__at >> 6").alias("__word"), bit("__at").alias("__bit"))
    mask = written(set_bits.groupBy("__word").agg(F.bit_or("__bit").alias("__mask")), "key_filter")
    probed = rows.withColumn("__at", F.when(F.col(key).isNotNull(), place(key))).withColumn("__word", F.expr("__at >> 6"))
    return probed.join(F.broadcast(mask), "__word").where(F.expr("__mask & shiftleft(1L, CAST(__at & 63 AS INT))") != 0).select(*rows.columns)


def join_skewed(rows: DataFrame, key: str, spread: list[str], lookup: DataFrame, lookup_key: str, weights: DataFrame, weights_key: str, weight: str, parts: int = 1024) -> DataFrame:
    """Inner join of *rows* with *lookup* (one row per key), with hot keys salted. *weights* gives how many *rows* each key has.

    A key is hot if it holds more than 1/*parts* of all weight, so there are fewer than *parts* of them, whatever the data:
    that bound is what allows their table to be broadcast. Rows of a hot key that *lookup* does not have are dropped before
    the shuffle, which an inner join loses nothing by. Those it has are spread by the hash of *spread* over copies of their
    lookup row, one for each *parts*-th of all weight, so no key and salt has more than about that. All others join plainly.
    *lookup* and *weights* should be written data.
    """
    total = weights.agg(F.sum(weight)).first()[0] or 0
    hot = weights.where(F.col(weights_key).isNotNull() & (F.col(weight) * parts > F.lit(total)))
    hot = hot.select(F.col(weights_key).alias("__hot"), F.ceil(F.col(weight) * parts / F.lit(max(total, 1))).cast("int").alias("__salts"))
    there = lookup.join(F.broadcast(hot), F.col(lookup_key) == F.col("__hot"), "left_semi").select(F.col(lookup_key).alias("__hot"), F.lit(True).alias("__there"))
    hot = F.broadcast(written(hot.join(F.broadcast(there), "__hot", "left"), "hot_keys"))
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("__salts"))).otherwise(0).cast("int")
    salted = rows.join(hot, F.col(key) == F.col("__hot"), "left").where(F.col("__salts").isNull() | F.col("__there"))
    salted = salted.select(*rows.columns, salt.alias("__salt"))
    copies = lookup.join(hot.select("__hot", "__salts"), F.col(lookup_key) == F.col("__hot"), "left")
    copies = copies.select(*lookup.columns, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))).alias("__t_salt"))
    joined = salted.join(copies, (F.col(key) == F.col(lookup_key)) & (F.col("__salt") == F.col("__t_salt")))
    return joined.drop("__salt", "__t_salt")
