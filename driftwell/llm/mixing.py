"""Mixing sources to target shares of all tokens, in the order of a time-varying curriculum.

Training time runs from 0 to 1. A source's weight over that time is piecewise linear (constant where no schedule is given);
its integral, scaled so that it ends at the source's demand, is the cumulative token demand of the source. A document's
place in its source's shuffled order gives the cumulative tokens before it, and inverting the demand curve there gives its
training position. The selection is range-sorted by position.

demand is target_share times the tokens of all documents, supply the source's tokens times max_repeats. A source passes
over its documents again until the demand is met, or the repeats are used up; the copy whose middle passes the demand is
the first left out, so the tokens reached differ from the demand by at most half a document.

The order within a source comes from hash buckets: bucket sums are added up per source, and running sums are made only
within a bucket. A source with a third of all documents is spread over all its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.tokens import TOKENIZER, n_tokens
from driftwell.session import broadcast_if_small, with_package, written

#: Documents per bucket aimed at.
BUCKET_ROWS = 20_000


def source_name(column: Column) -> Column:
    """A source as it is compared: trimmed, lower case, with - for _, blank as NULL."""
    return F.nullif(F.translate(F.lower(F.trim(column)), "_", "-"), F.lit(""))


def token_table(df: DataFrame, doc_id: Column, source: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """Written table doc_id, source, n_tokens of all documents."""
    return written(with_package(df).select(doc_id.alias("doc_id"), source_name(source).alias("source"), n_tokens(text, tokenizer).alias("n_tokens")), "tokens")


def curves(schedule: dict[str, list[tuple[float, float]]] | None) -> dict[str, list[tuple[float, float, float, float, float]]]:
    """Segments (share reached before, from time, to time, weight there, weight here) of each scheduled source.

    A schedule is a list of (time, weight) knots from time 0 to 1, weights at least 0 and not all 0.
    """
    out = {}
    for name, knots in (schedule or {}).items():
        if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or min(w for _, w in knots) < 0:
            raise ValueError(f"schedule of {name}: knots must rise from time 0 to 1 with weights of at least 0")
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, before, segments = sum(areas), 0.0, []
        if whole <= 0:
            raise ValueError(f"schedule of {name}: all weights are 0")
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            segments.append((before / whole, t0, t1, w0 / whole, w1 / whole))
            before += area
        out[name] = segments
    return out


def _time_of(source: Column, reached: Column, segments: dict[str, list[tuple[float, float, float, float, float]]]) -> Column:
    """Inverse of the scaled cumulative demand: the time at which *reached* (0 to 1) of the source's tokens is due."""
    time = reached
    for name, parts in segments.items():
        inverse = F.lit(None).cast("double")
        for before, t0, t1, w0, w1 in parts:  # later segments override
            area, slope = reached - F.lit(before), (w1 - w0) / (t1 - t0)
            if abs(slope) < 1e-12:
                at = F.lit(t0) + (area / F.lit(w0) if w0 else F.lit(0.0))
            else:
                root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * area, F.lit(0.0)))
                at = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
            inverse = F.when(reached >= F.lit(before), F.least(at, F.lit(t1))).otherwise(inverse)
        time = F.when(source == name, inverse).otherwise(time)
    return time


def demands(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, max_repeats, source_tokens, demand, supply.

    *targets* has source, target_share, max_repeats; NULL share counts as 0, NULL repeats as 1; spellings of one source are
    added up (shares) or the largest taken (repeats). A source without documents has 0 tokens.
    """
    whole = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("r")).where(F.col("source").isNotNull())
    wanted = wanted.groupBy("source").agg(F.sum("s").alias("target_share"), F.max("r").cast("long").alias("max_repeats"))
    held = tokens.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    both = wanted.join(held, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    both = both.withColumn("demand", F.col("target_share") * F.lit(float(whole))).withColumn("supply", F.col("max_repeats") * F.col("source_tokens"))
    return both.withColumn("all_tokens", F.lit(whole).cast("long"))


def selection(tokens: DataFrame, demand: DataFrame, seed: int = 17, bucket_rows: int = BUCKET_ROWS, schedule: dict[str, list[tuple[float, float]]] | None = None) -> DataFrame:
    """The selected copies: source, doc_id, copy_no (from 1), n_tokens, position (training time). *tokens* and *demand* should be written data."""
    bits = max(0, math.ceil(math.log2(max(1, tokens.count()) / bucket_rows)))
    hashed = tokens.join(broadcast_if_small(demand.select("source", "demand", "max_repeats", "source_tokens", "supply")), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    hashed = hashed.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["source", "bucket"]).withColumn("middle", F.col("offset") + F.col("before") + F.col("n_tokens") / 2)
    passes = F.floor((F.col("demand") - F.col("middle")) / F.greatest(F.col("source_tokens"), F.lit(1))) + 1
    copies = placed.withColumn("copies", F.least(F.greatest(passes, F.lit(0)), F.col("max_repeats")).cast("int")).where(F.col("copies") > 0)
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    reach = F.least(F.col("demand"), F.col("supply").cast("double"))
    reached = F.when(reach > 0, F.least(((F.col("copy_no") - 1) * F.col("source_tokens") + F.col("middle")) / reach, F.lit(1.0))).otherwise(F.lit(0.0))
    return copies.select("source", "doc_id", "copy_no", "n_tokens", _time_of(F.col("source"), reached, curves(schedule)).alias("position"))


def in_training_order(selected: DataFrame) -> DataFrame:
    """Range-sorted by position; equal positions by source, document and copy."""
    return selected.orderBy("position", "source", "doc_id", "copy_no")


def mixing_report(selected: DataFrame, demand: DataFrame) -> DataFrame:
    """Per target source the tokens and documents selected and its shares of all tokens and of the selection.

    reached is false for a source that the selection used up, every document max_repeats times, and that is still short of
    its demand: no order of its documents can give more.
    """
    got = selected.groupBy("source").agg(F.sum("n_tokens").alias("selected_tokens"), F.count(F.lit(1)).alias("selected_rows"), F.max("copy_no").alias("most_repeats"))
    used_up = (F.col("selected_tokens") == F.col("supply")) & (F.col("selected_tokens") < F.col("demand"))
    report = written(demand.join(got, "source", "left").fillna(0, ["selected_tokens", "selected_rows", "most_repeats"]).withColumn("reached", ~used_up), "mixing_report")
    chosen = report.agg(F.sum("selected_tokens")).first()[0] or 0
    share = lambda whole: F.try_divide(F.col("selected_tokens").cast("double"), whole)
    return report.withColumn("share_of_all", share(F.col("all_tokens").cast("double"))).withColumn("share_of_selection", share(F.lit(float(chosen))))


def mix(df: DataFrame, doc_id: Column, source: Column, text: Column, targets: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, demands) of documents by source; see selection() and demands(). Documents of no target source count in the whole only."""
    tokens = token_table(df, doc_id, source, text, tokenizer)
    demand = written(demands(tokens, targets), "demands")
    return selection(tokens, demand, seed, schedule=schedule), demand
