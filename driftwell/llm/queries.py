"""Registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import distinct_runs, frequent, mixing, packing, reading, top_items
from driftwell.session import written
from driftwell.sources.tables import day_of, table, tidy

# --- 2: distinct counts over huge identifier sets -----------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored runs per day and channel; rows of each such group."""
    bid = table(spark, d, "bid")
    group = {"day": day_of("date_time"), "channel": tidy("channel")}
    sizes = written(bid.groupBy(*[c.alias(n) for n, c in group.items()]).agg(F.count(F.lit(1)).alias("n")), "group_sizes")
    bits = distinct_runs.shard_bits(sizes, ["day", "channel"])
    measures = {"bid": F.col("bid_id"), "bidder": F.col("bidder"), "auction": F.col("auction")}
    partial = distinct_runs.partial_runs(bid, group, measures, bits)
    return written(distinct_runs.merge_runs(partial, ["day", "channel"]), "runs"), sizes


def _coarser(runs: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    return distinct_runs.distinct_counts(distinct_runs.merge_runs(runs, group, distinct_runs.shard_bits(sizes, group)), group)


def _with_bids(counts: DataFrame) -> DataFrame:
    """Per group and measure, beside the distinct identifiers the distinct bids of the group."""
    per_group = counts.groupBy("day", "channel").agg(
        F.max(F.when(F.col("measure") == "bid", F.col("n_distinct"))).alias("n_bids"),
        *[F.struct(F.coalesce(F.max(F.when(F.col("measure") == m, F.col("n_distinct"))), F.lit(0)).alias("n"), F.max(F.when(F.col("measure") == m, F.col("collision_bound"))).alias("e")).alias(m) for m in ("bidder", "auction")],
    )
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}.n").alias("n_distinct"), F.coalesce(F.col(f"{m}.e"), F.lit(0.0)).alias("collision_bound")) for m in ("bidder", "auction")])
    return per_group.select("day", "channel", "n_bids", F.inline(each))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    runs, sizes = _runs(spark, d)
    fine = distinct_runs.distinct_counts(runs, ["day", "channel"]).where(F.col("channel").isNotNull())
    days = _coarser(runs, sizes, ["day"]).withColumn("channel", F.lit("*"))
    counts = _with_bids(fine.unionByName(days))
    return counts.where((F.col("n_bids") >= 10) & (F.col("n_distinct") * 10 >= F.col("n_bids") * 7)).select("day", "channel", "measure")


def p2_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Per day, per channel and per both ('*' stands for all): bids, distinct identifiers and the error bound."""
    runs, sizes = _runs(spark, d)
    fine = distinct_runs.distinct_counts(runs, ["day", "channel"]).where(F.col("channel").isNotNull())
    days = _coarser(runs, sizes, ["day"]).withColumn("channel", F.lit("*"))
    channels = _coarser(runs, sizes, ["channel"]).where(F.col("channel").isNotNull()).withColumn("day", F.lit("*"))
    return _with_bids(fine.unionByName(days).unionByName(channels))


_TIDY = "nullif(lower(trim({0}, ' ')), '')"
_P2_SQL = f"""
    WITH b AS (SELECT DISTINCT bid_id, CAST(CAST(date_time AS DATE) AS VARCHAR) AS day, {_TIDY.format("channel")} AS channel, bidder, auction FROM bid),
    g AS (SELECT * FROM b WHERE channel IS NOT NULL UNION ALL SELECT bid_id, day, '*', bidder, auction FROM b {{extra}}),
    c AS (SELECT day, channel, count(*) AS n_bids, count(DISTINCT bidder) AS bidders, count(DISTINCT auction) AS auctions FROM g GROUP BY ALL),
    m AS (SELECT day, channel, n_bids, 'bidder' AS measure, bidders AS n_distinct FROM c UNION ALL SELECT day, channel, n_bids, 'auction', auctions FROM c)
"""

# --- 3: top N items within every group ----------------------------------------------------------------------------


def _top_bids(spark: SparkSession, d: str, n: int) -> DataFrame:
    bid = table(spark, d, "bid")
    return top_items.top_items(bid, F.col("auction"), F.col("price"), {"date_time": F.col("date_time"), "bid_id": F.col("bid_id")}, n, "auction", "price")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _top_bids(spark, d, 3).select("auction", "rank_no", "bid_id")


def p3_top10_bids(spark: SparkSession, d: str) -> DataFrame:
    return _top_bids(spark, d, 10).select("auction", "rank_no", "bid_id", "price")


def p3_skipping(spark: SparkSession, d: str) -> DataFrame:
    """What p3_found reads and skips: items, row groups read, ruled out by footers, and passed over within a file."""
    bid = table(spark, d, "bid")
    return top_items.skipping_report(bid, F.col("auction"), F.col("price"), {"date_time": F.col("date_time"), "bid_id": F.col("bid_id")}, 3)


_P3_SQL = """
    WITH b AS (SELECT DISTINCT auction, price, date_time, bid_id FROM bid WHERE auction IS NOT NULL AND price IS NOT NULL)
    SELECT auction, row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time, bid_id) AS rank_no, bid_id{0} FROM b QUALIFY rank_no <= {1}"""

# --- 4: most frequent items among billions ------------------------------------------------------------------------


def page_of(url: Column) -> Column:
    """The page behind a url: up to the first ? or #, lower case, without / at the end."""
    return F.rtrim(F.lower(F.substring_index(F.substring_index(url, "?", 1), "#", 1)), F.lit("/"))


def _bid_fields() -> dict[str, Column]:
    return {"bidder": F.col("bidder").cast("string"), "url": page_of(F.col("url"))}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    top = frequent.most_frequent(table(spark, d, "bid"), F.col("bid_id"), _bid_fields(), k=100, min_share=0.01)
    return top.where(F.col("n_rows") * 100 >= F.col("of_rows")).select("field", "item")


def p4_top10(spark: SparkSession, d: str) -> DataFrame:
    return frequent.most_frequent(table(spark, d, "bid"), F.col("bid_id"), _bid_fields(), k=10)


_P4_SQL = """
    WITH b AS (SELECT DISTINCT bid_id, bidder, url FROM bid),
    v AS (SELECT 'bidder' AS field, CAST(bidder AS VARCHAR) AS item FROM b WHERE bidder IS NOT NULL
        UNION ALL SELECT 'url', rtrim(lower(split_part(split_part(url, '?', 1), '#', 1)), '/') FROM b WHERE url IS NOT NULL),
    n AS (SELECT count(DISTINCT bid_id) AS of_rows FROM bid),
    c AS (SELECT field, item, count(*) AS n_rows FROM v GROUP BY ALL)
"""

# --- 6: filling fixed-capacity containers with items --------------------------------------------------------------


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents the packer split: each has one second part."""
    return _packed(spark, d).where(F.col("part_no") == 1).select(F.col("item_id").alias("doc_id"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item_id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every assignment: documents assigned, and how many containers are overfull or documents split without need or lost in part."""
    assigned = written(_packed(spark, d), "assigned")
    docs = assigned.groupBy("item_id").agg(F.count(F.lit(1)).alias("parts"), F.max("n_tokens").alias("tokens"), F.sum("part_tokens").alias("placed"))
    least = F.greatest(F.ceil(F.col("tokens") / F.lit(packing.CAPACITY)), F.lit(1))
    counted = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    of_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"), counted(F.col("parts") > least).alias("split_needlessly"), counted(F.col("placed") != F.col("tokens")).alias("placed_in_part"))
    full = assigned.groupBy("container").agg(F.sum("part_tokens").alias("used")).agg(counted(F.col("used") > packing.CAPACITY).alias("overfull"))
    both = of_docs.unionByName(full, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n_docs", "split_needlessly", "placed_in_part", "overfull")])


# --- 7: mixing sources to target weights --------------------------------------------------------------------------

#: Forge commits fade out while teaching material and notes grow towards the end of training.
CURRICULUM = {
    "forge-a": [(0.0, 1.5), (1.0, 0.5)],
    "forge-b": [(0.0, 1.2), (0.5, 1.2), (1.0, 0.4)],
    "teaching": [(0.0, 0.2), (0.6, 0.8), (1.0, 2.4)],
    "wiki-notes": [(0.0, 0.0), (1.0, 2.0)],
}


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), F.col("doc_id"), F.col("source"), F.col("text"), table(spark, d, "mix_target"), CURRICULUM)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose whole selection, every document as often as allowed, falls short of the demand."""
    return mixing.mixing_report(*_mixed(spark, d)).where(~F.col("reached")).select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixing_report(*_mixed(spark, d))


def p7_training_order(spark: SparkSession, d: str) -> DataFrame:
    return mixing.in_training_order(_mixed(spark, d)[0])


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: documents there are, and rows of the selection used too often, twice under one copy number, outside training time or missing an earlier copy."""
    selected, demand = _mixed(spark, d)
    selected = written(selected, "selected")
    docs = selected.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy_no").alias("copies"), F.max("copy_no").alias("last"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    held = table(spark, d, "documents").select(mixing.source_name(F.col("source")).alias("source")).where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    wrong = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    per = demand.select("source", "max_repeats").join(docs, "source", "left").groupBy("source").agg(
        wrong(F.col("last") > F.col("max_repeats")).alias("used_too_often"), wrong((F.col("n") != F.col("copies")) | (F.col("copies") != F.col("last"))).alias("copies_wrong"), wrong((F.col("lo") < 0) | (F.col("hi") > 1)).alias("outside_time"))
    return per.join(held, "source", "left").fillna(0, ["n_docs"])


# --- 8: reading level of each document ----------------------------------------------------------------------------


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), table(spark, d, "reading_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where(F.col("n_above") >= 2).select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences per level."""
    return _levels(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_sentences").alias("n_sentences"), F.avg("formula").alias("mean_formula"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One level a document: documents, those with several rows, levels outside the bands, and prose counted beyond its sentences."""
    levels = written(_levels(spark, d), "levels")
    counted = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    docs = levels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), counted(F.col("n") > 1).alias("repeated"))
    bad = levels.agg(counted(~F.col("level").between(0, len(reading.EDGES)) | (F.col("level").isNull() != (F.col("n_sentences") == 0))).alias("level_wrong"), counted((F.col("n_above") > F.col("n_sentences")) | ~F.coalesce(F.col("posterior"), F.lit(1.0)).between(0.0, 1.0 + 1e-9)).alias("counts_wrong"))
    return docs.unionByName(bad, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n_docs", "repeated", "level_wrong", "counts_wrong")])


QUERIES = {
    "p2_found": p2_found,
    "p2_distinct": p2_distinct,
    "p3_found": p3_found,
    "p3_top10_bids": p3_top10_bids,
    "p3_skipping": p3_skipping,
    "p4_found": p4_found,
    "p4_top10": p4_top10,
    "p6_found": p6_found,
    "p6_assignment": p6_assignment,
    "p6_fill": p6_fill,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_training_order": p7_training_order,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
    "p8_invariants": p8_invariants,
}

_SOURCE = "nullif(replace(lower(trim({0}, ' ')), '_', '-'), '')"

SQL = {
    "p2_found": _P2_SQL.format(extra="") + "SELECT day, channel, measure FROM m WHERE n_bids >= 10 AND n_distinct * 10 >= n_bids * 7",
    "p2_distinct": _P2_SQL.format(extra="UNION ALL SELECT bid_id, '*', channel, bidder, auction FROM b WHERE channel IS NOT NULL") + "SELECT day, channel, n_bids, measure, n_distinct, CAST(n_distinct AS DOUBLE) * (CAST(n_distinct AS DOUBLE) - 1) / pow(2.0, 65) AS collision_bound FROM m",
    "p3_found": _P3_SQL.format("", 3),
    "p3_top10_bids": _P3_SQL.format(", price", 10),
    "p4_found": _P4_SQL + "SELECT field, item FROM c, n WHERE n_rows * 100 >= of_rows",
    "p4_top10": _P4_SQL + "SELECT field, item, n_rows, of_rows FROM c, n QUALIFY row_number() OVER (PARTITION BY field ORDER BY n_rows DESC, item) <= 10",
    "p6_invariants": "SELECT count(DISTINCT doc_id) AS n_docs, CAST(0 AS BIGINT) AS split_needlessly, CAST(0 AS BIGINT) AS placed_in_part, CAST(0 AS BIGINT) AS overfull FROM documents",
    "p7_invariants": f"""
        WITH t AS (SELECT DISTINCT {_SOURCE.format("source")} AS source FROM mix_target), s AS (SELECT {_SOURCE.format("source")} AS source, count(*) AS n_docs FROM documents GROUP BY 1)
        SELECT source, coalesce(n_docs, 0) AS n_docs, CAST(0 AS BIGINT) AS used_too_often, CAST(0 AS BIGINT) AS copies_wrong, CAST(0 AS BIGINT) AS outside_time FROM t LEFT JOIN s USING (source) WHERE source IS NOT NULL""",
    "p8_invariants": "SELECT count(DISTINCT doc_id) AS n_docs, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS level_wrong, CAST(0 AS BIGINT) AS counts_wrong FROM documents",
}
