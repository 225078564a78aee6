"""Registered queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import orphans, skew
from driftwell.sources.tables import day_of, table, tidy

# --- 1: a few keys holding most records ---------------------------------------------------------------------------


def _profiles(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    bid, orders, log = (table(spark, d, t) for t in ("bid", "m0_orders", "m2a_log"))
    none = F.lit("")
    return [
        ("bid", skew.key_profile(bid, {"cell": none, "key_value": F.col("auction").cast("string")}, F.col("price"))),
        ("m0_orders", skew.key_profile(orders, {"cell": none, "key_value": tidy("region")}, F.col("amount"))),
        ("m2a_log", skew.key_profile(log, {"cell": F.col("cell"), "key_value": F.col("g").cast("string")}, F.col("amount"))),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [skew.heavy_keys(p, ["cell"], "key_value", 50).select(F.lit(name).alias("table_name"), "cell", "key_value") for name, p in _profiles(spark, d)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _rounded(profile: DataFrame) -> DataFrame:
    return profile.withColumn("total", F.col("total").cast("long"))


def p1_bid_auction(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skew.key_profile(table(spark, d, "bid"), {"auction": F.col("auction")}, F.col("price"), (0.5, 0.9)))


def p1_m0_region(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skew.key_profile(table(spark, d, "m0_orders"), {"region": tidy("region")}, F.col("amount"), (0.5, 0.9)))


def p1_m2a_group(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skew.key_profile(table(spark, d, "m2a_log"), {"cell": F.col("cell"), "g": F.col("g")}, F.col("amount"), (0.5, 0.9)))


_TIDY = "nullif(lower(trim({0}, ' ')), '')"


def _profile_sql(table_name: str, keys: dict[str, str], value: str) -> str:
    named = ", ".join(f"{e} AS {k}" for k, e in keys.items())
    names = ", ".join(keys)
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM m.{k}" for k in keys)
    return f"""
        WITH r AS (SELECT {named}, {value} AS v FROM {table_name}),
        f AS (SELECT {names}, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL),
        m AS (SELECT {names}, v AS mode FROM f QUALIFY row_number() OVER (PARTITION BY {names} ORDER BY n DESC, v) = 1)
        SELECT {", ".join(f"a.{k}" for k in keys)}, n_rows, n_values, total, n_distinct, mode, p50, p90
        FROM (SELECT {names}, count(*) AS n_rows, count(v) AS n_values, CAST(sum(v) AS BIGINT) AS total, count(DISTINCT v) AS n_distinct,
              quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90 FROM r GROUP BY {names}) a LEFT JOIN m ON {on}"""


_P1_FOUND_SQL = f"""
    WITH k AS (
        SELECT 'bid' AS table_name, '' AS cell, CAST(auction AS VARCHAR) AS key_value FROM bid
        UNION ALL SELECT 'm0_orders', '', {_TIDY.format("region")} FROM m0_orders
        UNION ALL SELECT 'm2a_log', cell, CAST(g AS VARCHAR) FROM m2a_log),
    c AS (SELECT table_name, cell, key_value, count(*) AS n FROM k GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY table_name, cell) AS everything FROM c)
    SELECT table_name, cell, key_value FROM t WHERE key_value IS NOT NULL AND n * 50 >= everything"""

# --- 5: references to records that do not exist -------------------------------------------------------------------


def _bid_orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.references(table(spark, d, "bid"), F.col("bid_id"), F.col("auction"), F.col("date_time"), F.col("ingest_time"))
    there = orphans.existence_delta(table(spark, d, "auction"), F.col("id"), F.col("ingest_time"), F.col("deleted_at"))
    return orphans.find_orphans(refs, there, "bid")


def _auction_orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.references(table(spark, d, "auction"), F.col("id"), F.col("seller"), F.col("date_time"), F.col("ingest_time"))
    there = orphans.existence_delta(table(spark, d, "person"), F.col("id"), F.col("ingest_time"), F.col("deleted_at"))
    return orphans.find_orphans(refs, there, "auction")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [rows.select(F.lit(name).alias("table_name"), day_of("at").alias("day"), "row_id", "reason") for name, (rows, _) in (("bid", _bid_orphans(spark, d)), ("auction", _auction_orphans(spark, d)))]
    return parts[0].unionByName(parts[1])


def p5_orphans_by_day(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("table_name", "day", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def p5_current_orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys referred to that do not exist now, from the maintained state, with their references."""
    parts = [orphans.current_orphans(state).select(F.lit(name).alias("table_name"), "ref_key", F.col("refs").alias("n_refs")) for name, (_, state) in (("bid", _bid_orphans(spark, d)), ("auction", _auction_orphans(spark, d)))]
    return parts[0].unionByName(parts[1])


_P5_ROWS = """
    WITH b AS (SELECT bid_id AS row_id, min(auction) AS k, min(date_time) AS made, min(ingest_time) AS arr FROM bid GROUP BY bid_id),
    a AS (SELECT id AS row_id, min(seller) AS k, min(date_time) AS made, min(ingest_time) AS arr, min(deleted_at) AS del FROM auction GROUP BY id),
    p AS (SELECT id, min(ingest_time) AS arr, min(deleted_at) AS del FROM person GROUP BY id),
    x AS (
        SELECT 'bid' AS table_name, b.row_id, b.k, b.made, b.arr, a.row_id AS target, a.arr AS t_arr, a.del AS t_del FROM b LEFT JOIN a ON b.k = a.row_id
        WHERE b.k IS NOT NULL
        UNION ALL
        SELECT 'auction', a.row_id, a.k, a.made, a.arr, p.id, p.arr, p.del FROM a LEFT JOIN p ON a.k = p.id WHERE a.k IS NOT NULL),
    o AS (SELECT table_name, CAST(CAST(made AS DATE) AS VARCHAR) AS day, row_id, k, target, t_del,
        CASE WHEN target IS NULL THEN 'missing' WHEN t_del <= made THEN 'deleted' WHEN t_arr > arr THEN 'late' END AS reason FROM x)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_bid_auction": p1_bid_auction,
    "p1_m0_region": p1_m0_region,
    "p1_m2a_group": p1_m2a_group,
    "p5_found": p5_found,
    "p5_orphans_by_day": p5_orphans_by_day,
    "p5_current_orphan_keys": p5_current_orphan_keys,
}

SQL = {
    "p1_found": _P1_FOUND_SQL,
    "p1_bid_auction": _profile_sql("bid", {"auction": "auction"}, "price"),
    "p1_m0_region": _profile_sql("m0_orders", {"region": _TIDY.format("region")}, "amount"),
    "p1_m2a_group": _profile_sql("m2a_log", {"cell": "cell", "g": "g"}, "amount"),
    "p5_found": _P5_ROWS + "SELECT table_name, day, row_id, reason FROM o WHERE reason IS NOT NULL",
    "p5_orphans_by_day": _P5_ROWS + "SELECT table_name, day, reason, count(*) AS n_rows FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_current_orphan_keys": _P5_ROWS + "SELECT table_name, k AS ref_key, count(*) AS n_refs FROM o WHERE target IS NULL OR t_del IS NOT NULL GROUP BY ALL",
}
