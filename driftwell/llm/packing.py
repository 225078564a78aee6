"""Filling containers of fixed capacity by bounded-space online packing.

Every partition reads its documents once, counts tokens and keeps a fixed number of open windows. A document goes to the
open window with the least room that still takes it; where none does, the fullest window is emitted and a new one opened.
Nothing is shuffled. Only a document longer than the capacity is split: into full containers, and a rest that is packed
like any other document.

The windows left open at the ends of partitions, at most *open_windows* each, are merged in rounds: up to *fan_in*
partitions' leftovers meet in one task and are packed, largest first, into each other; again at most *open_windows* stay
open for the next round. A window moves as a whole, so each round only adds (window, container) pairs, of which there are
fewer than partitions times open windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.tokens import TOKENIZER, counter
from driftwell.session import broadcast_if_small, with_package, written

CAPACITY = 2048
OPEN_WINDOWS = 64
FAN_IN = 64


class OpenWindows:
    """A fixed number of open windows of one capacity."""

    def __init__(self, capacity: int, most: int, first_id: int) -> None:
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.open: list[tuple[int, int]] = []  # (room, id), least room first

    def place(self, size: int) -> int:
        """Id of the window that takes an item of *size* at most the capacity."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            room, window = self.capacity, self.new()
        insort(self.open, (room - size, window))
        return window

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1


def split(tokens: int, capacity: int) -> list[int]:
    """Sizes of the parts of an item: itself if it fits, else full containers and the rest."""
    if tokens <= capacity:
        return [tokens]
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + ([rest] if rest else [])


_SCHEMA = "item_id long, n_tokens long, part_no long, part_tokens long, window long, room long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _SCHEMA.split(", ")])


def _packed(df: DataFrame, item_id: Column, text: Column, capacity: int, open_windows: int, tokenizer: str) -> DataFrame:
    """Parts with their windows, and one row without item per window left open, with its room."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        windows = OpenWindows(capacity, open_windows, TaskContext.get().partitionId() << 36)
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW.names]
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = count(value.as_py())
                for part, size in enumerate(split(tokens, capacity)):
                    window = windows.new() if size == capacity else windows.place(size)
                    for column, x in zip(out, (item, tokens, part, size, window, None)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_ARROW)
        left = [[None] * len(windows.open)] * 4 + [[w for _, w in windows.open], [r for r, _ in windows.open]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in left], schema=_ARROW)

    return with_package(df).select(item_id.cast("long"), text).mapInArrow(task, _SCHEMA)


_MERGE_SCHEMA = "task long, container long, used long, members array<long>, open boolean"


def _merged(leftovers: DataFrame, capacity: int, open_windows: int, fan_in: int, last: bool) -> DataFrame:
    """One round: the leftovers of *fan_in* tasks packed into each other, largest first."""

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["used"], r["container"]))
        windows, inside = OpenWindows(capacity, len(rows), 0), []
        for r in rows:
            at = windows.place(r["used"])
            if at == len(inside):
                inside.append([])
            inside[at].append(r)
        roomy = {w for room, w in windows.open[::-1][:open_windows] if room} if not last else set()
        task, keep, done = key[0].as_py(), [], []
        for at, group in enumerate(inside):
            row = {"task": task, "container": group[0]["container"], "used": sum(r["used"] for r in group), "members": [m for r in group for m in r["members"]], "open": at in roomy}
            (keep if at in roomy else done).append(row)
        schema = pa.schema([("task", pa.int64()), ("container", pa.int64()), ("used", pa.int64()), ("members", pa.list_(pa.int64())), ("open", pa.bool_())])
        return pa.Table.from_pylist(done + keep, schema=schema)

    met = leftovers.withColumn("task", F.floor(F.col("task") / fan_in).cast("long")).groupBy("task")
    return met.applyInArrow(unite, _MERGE_SCHEMA)


def pack(df: DataFrame, item_id: Column, text: Column, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every item in its container: item_id, n_tokens, part_no, part_tokens, container.

    An item of at most *capacity* tokens is one part; NULL and empty texts have 0 tokens and take no room, but are assigned
    as well. Rows with the same or no item_id are items of their own. The first read of the documents is written to the
    shared folder, so a lost executor neither repeats nor reorders it.
    """
    parts = written(_packed(df, item_id, text, capacity, open_windows, tokenizer), "packed")
    open_rows = parts.where(F.col("room").isNotNull())
    leftovers = open_rows.select((F.shiftright("window", 36)).alias("task"), F.col("window").alias("container"), (F.lit(capacity) - F.col("room")).alias("used"), F.array("window").alias("members"), F.lit(True).alias("open"))
    tasks = (leftovers.agg(F.max("task")).first()[0] or 0) + 1
    moved: DataFrame | None = None
    while True:
        last = tasks <= fan_in
        step = written(_merged(leftovers, capacity, open_windows, fan_in, last), "leftovers")
        settled = step.where(~F.col("open")).select("container", F.explode("members").alias("window"))
        moved = settled if moved is None else moved.unionByName(settled)
        if last:
            break
        leftovers, tasks = step.where("open"), -(-tasks // fan_in)
    items = parts.where(F.col("room").isNull()).drop("room")
    joined = items.join(broadcast_if_small(moved), "window", "left")
    return joined.select("item_id", "n_tokens", "part_no", "part_tokens", F.coalesce("container", "window").alias("container"))


def fill_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill (share of the room used) and the most tokens in a container."""
    per = assigned.groupBy("container").agg(F.sum("part_tokens").alias("used"))
    whole = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return whole.withColumn("fill", F.try_divide(F.col("tokens").cast("double"), F.col("containers") * F.lit(float(capacity))))
