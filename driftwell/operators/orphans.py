"""References to records that do not exist.

State: one row per referenced key with signed counts, built from change deltas only.

    ref_key, refs (sum of reference changes), alive (sum of existence changes), arrived (first arrival of the record),
    deleted (first deletion), first_ref (first arrival of a reference), last_ref (latest event time of a reference)

A reference coming or going adds +1 or -1 to refs; a record arriving adds +1 to alive, being deleted -1. Keys with positive
refs and zero alive are the current orphans. Counts add up and times fold by min and max, so deltas merge in any order and
any batching, and partial aggregation keeps hot keys small. The row-level report compares each reference with the state of
its key, after the state has ruled out the keys that cannot fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators.skew import join_skewed, possibly_in
from driftwell.session import written

STATE = ["ref_key", "refs", "alive", "arrived", "deleted", "first_ref", "last_ref"]


def references(df: DataFrame, row_id: Column, key: Column, at: Column, arrived: Column) -> DataFrame:
    """Referring rows, once per row_id: row_id, ref_key, at, ref_arrived (its earliest). Rows of one row_id agree but for *arrived*.

    Rows without row_id cannot be told apart and count each by its other values; rows without key refer to nothing and are
    left out. Of copies that disagree the smallest key and time count.
    """
    rows = df.select(row_id.alias("row_id"), key.alias("ref_key"), at.alias("at"), arrived.alias("ref_arrived"))
    once = rows.groupBy("row_id").agg(F.min("ref_key").alias("ref_key"), F.min("at").alias("at"), F.min("ref_arrived").alias("ref_arrived"))
    return once.where(F.col("ref_key").isNotNull() & F.col("row_id").isNotNull())


def reference_delta(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Change rows of references that came (+1) or went (-1)."""
    none = F.lit(None).cast(refs.schema["ref_arrived"].dataType)
    return refs.select("ref_key", F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("alive"), none.alias("arrived"), none.alias("deleted"), F.col("ref_arrived").alias("first_ref"), F.col("at").alias("last_ref"))


def existence_delta(records: DataFrame, key: Column, arrived: Column, deleted: Column) -> DataFrame:
    """Change rows of records: +1 where an id first arrives, -1 where it is first deleted; repeated deliveries change nothing."""
    once = records.select(key.alias("ref_key"), arrived.alias("arrived"), deleted.alias("deleted")).where(F.col("ref_key").isNotNull())
    once = once.groupBy("ref_key").agg(F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"))
    none = F.lit(None).cast(once.schema["arrived"].dataType)
    alive = F.lit(1) - F.when(F.col("deleted").isNotNull(), 1).otherwise(0)
    return once.select("ref_key", F.lit(0).cast("long").alias("refs"), alive.cast("long").alias("alive"), "arrived", "deleted", none.alias("first_ref"), none.alias("last_ref"))


def fold(*deltas: DataFrame) -> DataFrame:
    """State of all *deltas*; a state is itself a delta, so fold(state, delta) maintains it."""
    union = deltas[0].select(*STATE)
    for delta in deltas[1:]:
        union = union.unionByName(delta.select(*STATE))
    return union.groupBy("ref_key").agg(
        F.sum("refs").alias("refs"), F.sum("alive").alias("alive"), F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"),
        F.min("first_ref").alias("first_ref"), F.max("last_ref").alias("last_ref"),
    )


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist now."""
    return state.where((F.col("refs") > 0) & (F.col("alive") <= 0))


def suspects(state: DataFrame) -> DataFrame:
    """Keys of which a reference may have failed when it was made: orphans now, or arrived after their first reference."""
    orphan = (F.col("alive") <= 0) & (F.col("arrived").isNull() | (F.col("deleted") <= F.col("last_ref")))
    late = F.col("arrived") > F.col("first_ref")
    return state.where((F.col("refs") > 0) & (orphan | late))


def orphan_rows(refs: DataFrame, state: DataFrame) -> DataFrame:
    """Failing references: row_id, ref_key, at, reason.

    reason is the first that holds: missing (no record has the key), deleted (at or before the reference's own time), late
    (the record arrived after the reference did). A record whose arrival is not known counts as arrived in time; a
    reference without time cannot be found deleted. *refs* and *state* should be written data.

    A filter of the doubtful keys keeps most sound references out of the shuffle; hot keys are known from all of *state*, so
    a hot key is split whether it is doubtful or not.
    """
    doubtful = suspects(state).select(F.col("ref_key").alias("__key"), "refs", "arrived", "deleted", (F.col("alive").isNull() | F.col("arrived").isNull() & F.col("deleted").isNull() & (F.col("alive") <= 0)).alias("__missing"))
    doubtful = written(doubtful, "doubtful_keys")
    near = possibly_in(refs, "ref_key", doubtful, "__key")
    joined = join_skewed(near, "ref_key", ["row_id"], doubtful, "__key", state, "ref_key", "refs")
    reason = F.when(F.col("__missing"), "missing").when(F.col("deleted") <= F.col("at"), "deleted").when(F.col("arrived") > F.col("ref_arrived"), "late")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("row_id", "ref_key", "at", "reason")


def find_orphans(refs: DataFrame, existence: DataFrame, name: str = "orphans") -> tuple[DataFrame, DataFrame]:
    """(failing rows, state) of deduplicated references against existence changes, both written to the shared folder first."""
    refs = written(refs, f"{name}_refs")
    state = written(fold(reference_delta(refs), existence), f"{name}_state")
    return orphan_rows(refs, state), state
