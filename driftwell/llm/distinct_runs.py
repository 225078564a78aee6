"""Near-exact distinct counts from delta-coded sorted runs of 64-bit hashes.

Partial results are runs: for one group, measure and hash shard, the sorted distinct 64-bit hashes, stored as gaps. A map
task turns its rows into runs without a shuffle; runs of the same group and shard are merged by k-way union; and runs of
finer groups merge into those of coarser ones the same way, so nothing is counted twice and any batching gives the same
result. Counts over the shards of a group add up, as shards cut the hash space.

Shards bound the size of a run: shard_bits() picks, for each group by its own rows, enough leading hash bits that its rows
divided by its shards stay below *capacity*. A small group keeps one run however large another is. Only groups beyond the
capacity are listed, so the list is no longer than all rows divided by the capacity. Repeats of one identifier fold inside
each map task, so a hot identifier adds at most one hash per partial run.

Error: two identifiers are confused only if their hashes agree. With n distinct identifiers the expected undercount, and
the probability of any, is at most n (n - 1) / 2^65 (birthday bound), reported beside each count.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.session import broadcast_if_small, with_package, written

#: Rows a map task gathers before it cuts runs.
BUFFER_ROWS = 1 << 21
#: Rows of a group per shard aimed at.
CAPACITY = 1 << 20
_HEAD = struct.Struct("<IBQ")


def encode_run(hashes: np.ndarray) -> bytes:
    """Bytes of sorted distinct uint64 hashes: count, width, first hash, low bytes of the gaps, rest of the gaps as varints."""
    if len(hashes) == 0:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(hashes)
    width = min(7, max(0, int(math.log2(max(1.0, float(gaps.mean())))) // 8)) if len(gaps) else 0
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    rest = gaps >> np.uint64(8 * width)
    return _HEAD.pack(len(hashes), width, int(hashes[0])) + low + _varints(rest)


def _varints(values: np.ndarray) -> bytes:
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) != 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for j in range(int(sizes.max()) if len(sizes) else 0):
        at = np.flatnonzero(sizes > j)
        part = (values[at] >> np.uint64(7 * j)) & np.uint64(127)
        out[starts[at] + j] = part.astype(np.uint8) | np.where(sizes[at] - 1 > j, 128, 0).astype(np.uint8)
    return out.tobytes()


def decode_run(data: bytes) -> np.ndarray:
    """The hashes of encode_run."""
    n, width, first = _HEAD.unpack_from(data)
    if n == 0:
        return np.empty(0, np.uint64)
    gaps = np.zeros((n - 1, 8), np.uint8)
    low = np.frombuffer(data, np.uint8, (n - 1) * width, _HEAD.size).reshape(n - 1, width)
    gaps[:, :width] = low
    gaps = gaps.view("<u8").ravel().astype(np.uint64)
    tail = np.frombuffer(data, np.uint8, offset=_HEAD.size + (n - 1) * width)
    if n > 1:
        last = np.flatnonzero(tail < 128)
        starts = np.concatenate(([0], last[:-1] + 1))
        place = np.arange(len(tail)) - np.repeat(starts, last - starts + 1)
        parts = (tail & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
        gaps = gaps + (np.add.reduceat(parts, starts) << np.uint64(8 * width))
    return np.cumsum(np.concatenate((np.array([first], np.uint64), gaps)), dtype=np.uint64)


def union_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Union of sorted runs; the stable sort merges presorted stretches, so this is a k-way merge."""
    if len(runs) == 1:
        return runs[0]
    merged = np.concatenate(runs)
    merged.sort(kind="stable")
    keep = np.ones(len(merged), bool)
    keep[1:] = merged[1:] != merged[:-1]
    return merged[keep]


def _cut(groups: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, shard, sorted distinct hashes) of unordered rows; *bits* are each row's group's."""
    order = np.lexsort((hashes, groups))
    groups, hashes, bits = groups[order], hashes[order], bits[order]
    keep = np.ones(len(groups), bool)
    keep[1:] = (groups[1:] != groups[:-1]) | (hashes[1:] != hashes[:-1])
    groups, hashes, bits = groups[keep], hashes[keep], bits[keep].astype(np.uint64)
    shards = np.where(bits > 0, hashes >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]) | (shards[1:] != shards[:-1])))) if len(groups) else np.empty(0, np.int64)
    for a, b in zip(starts, [*starts[1:], len(groups)]):
        yield int(groups[a]), int(shards[a]), hashes[a:b]


def shard_bits(sizes: DataFrame, group: list[str], rows: str = "n", capacity: int = CAPACITY) -> DataFrame:
    """*group* and bits: leading bits of the hash that cut a group's rows into shards of at most about *capacity*; only groups that need any.

    *sizes* has the rows of each group or of finer ones, which are added up.
    """
    held = sizes.groupBy(*group).agg(F.sum(rows).alias(rows)).where(F.col(rows) > capacity)
    return held.select(*group, F.ceil(F.log2(F.col(rows) / F.lit(capacity))).cast("int").alias("bits"))


def _with_bits(df: DataFrame, names: list[str], bits: DataFrame | None, group: list[str]) -> DataFrame:
    """*df* with __bits of the group in its columns *names*, 0 for groups that *bits* does not list."""
    if bits is None:
        return df.withColumn("__bits", F.lit(0))
    listed = broadcast_if_small(written(bits, "shard_bits").select(*[F.col(g).alias(f"__b{i}") for i, g in enumerate(group)], F.col("bits").alias("__bits")))
    same = [F.col(n).eqNullSafe(F.col(f"__b{i}")) for i, n in enumerate(names)]
    return df.join(listed, same, "left").select(*df.columns, F.coalesce("__bits", F.lit(0)).alias("__bits"))


def partial_runs(df: DataFrame, group: dict[str, Column], measures: dict[str, Column], bits: DataFrame | None = None, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Runs of *df* without a shuffle: the group columns (as strings), measure, shard, n, run. *bits* as shard_bits() gives them.

    NULL is no identifier; a group with NULL in a group column is a group of its own. One map task may give several runs of
    the same group, measure and shard; merge_runs() unites them. An empty table gives no run.
    """
    names, wanted = list(group), list(measures)
    width, held = len(names), [f"__g{i}" for i in range(len(names))]
    rows = df.select(
        *[c.cast("string").alias(g) for g, c in zip(held, group.values())],
        *[F.when(c.isNotNull(), F.xxhash64(c)).alias(f"__m{i}") for i, c in enumerate(measures.values())],
    )
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("measure", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("n", T.LongType()), T.StructField("run", T.BinaryType())])
    arrow = pa.schema([*[(n, pa.string()) for n in names], ("measure", pa.string()), ("shard", pa.int64()), ("n", pa.int64()), ("run", pa.binary())])

    def coded(batch: pa.RecordBatch, seen: dict[tuple, int]) -> np.ndarray:
        """A number per row for its group; *seen* numbers the groups of the task."""
        code, dictionaries = np.zeros(batch.num_rows, np.int64), []
        for i in range(width):
            column = batch.column(i).dictionary_encode(null_encoding="encode")
            dictionaries.append(column.dictionary.to_pylist())
            code = code * len(dictionaries[-1]) + column.indices.to_numpy(zero_copy_only=False)
        found, place = np.unique(code, return_inverse=True)
        numbers = []
        for c in found.tolist():
            parts = []
            for d in reversed(dictionaries):
                c, at = divmod(c, len(d))
                parts.append(d[at])
            numbers.append(seen.setdefault(tuple(reversed(parts)), len(seen)))
        return np.array(numbers, np.int64)[place]

    def runs(gathered: list[tuple], seen: dict[tuple, int]) -> pa.RecordBatch:
        groups, shard_of = (np.concatenate([x[i] for x in gathered]) for i in (0, 1))
        named, out = list(seen), [[] for _ in arrow.names]
        for j, measure in enumerate(wanted):
            there, hashes = (np.concatenate([x[2][j][i] for x in gathered]) for i in (0, 1))
            for g, shard, part in _cut(groups[there], hashes[there], shard_of[there]):
                for place, value in enumerate((*named[g], measure, shard, len(part), encode_run(part))):
                    out[place].append(value)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, arrow.types)], schema=arrow)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, rows_held, seen = [], 0, {}
        for batch in batches:
            if batch.num_rows:
                measured = [(pc.is_valid(c).to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) for c in batch.columns[width:-1]]
                gathered.append((coded(batch, seen), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.uint8), measured))
                rows_held += batch.num_rows
            if rows_held >= buffer_rows:
                yield runs(gathered, seen)
                gathered, rows_held, seen = [], 0, {}
        if gathered:
            yield runs(gathered, seen)

    return _with_bits(with_package(rows), held, bits, names).mapInArrow(task, schema)


def merge_runs(runs: DataFrame, group: list[str], bits: DataFrame | None = None) -> DataFrame:
    """Runs united per *group* (some or all of the group columns), measure and shard of the group's *bits*.

    Runs with fewer bits than their group has here are first cut finer, without a shuffle, so coarser groups stay bounded as well.
    """
    keys = [*group, "measure", "shard"]
    schema = T.StructType([*[runs.schema[c] for c in [*group, "measure"]], T.StructField("shard", T.LongType()), T.StructField("n", T.LongType()), T.StructField("run", T.BinaryType())])
    arrow = pa.schema([*[(c, pa.string()) for c in [*group, "measure"]], ("shard", pa.int64()), ("n", pa.int64()), ("run", pa.binary())])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow.names]
            for *names, n, run, wanted in zip(*[batch.column(c).to_pylist() for c in [*group, "measure", "n", "run", "__bits"]]):
                if not wanted:
                    for place, value in enumerate([*names, 0, n, run]):
                        out[place].append(value)
                    continue
                hashes = decode_run(run)
                for _, shard, part in _cut(np.zeros(len(hashes), np.int64), hashes, np.full(len(hashes), wanted)):
                    for place, value in enumerate([*names, shard, len(part), encode_run(part)]):
                        out[place].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, arrow.types)], schema=arrow)

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        united = union_runs([decode_run(x) for x in table.column("run").to_pylist()])
        values = [*[table.column(c)[0].as_py() for c in [*group, "measure", "shard"]], len(united), encode_run(united)]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, arrow.types)], schema=arrow)

    cut = _with_bits(with_package(runs).select(*keys, "n", "run"), group, bits, group).mapInArrow(finer, schema) if bits is not None else with_package(runs).select(*keys, "n", "run")
    return cut.groupBy(*keys).applyInArrow(unite, schema)


def distinct_counts(runs: DataFrame, group: list[str]) -> DataFrame:
    """n_distinct per group and measure of merged runs, and collision_bound: expected undercount, and probability of any, at most."""
    counted = runs.groupBy(*group, "measure").agg(F.sum("n").alias("n_distinct"))
    n = F.col("n_distinct").cast("double")
    return counted.withColumn("collision_bound", n * (n - 1) / F.lit(2.0**65))
