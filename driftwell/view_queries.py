"""Registered queries of the view engine, and their SQL.

Each drives the incremental path over whole tables: a first load that misses rows, holds wrong values and rows of groups
that must vanish, then change batches with inserts, deletes and updates, with refreshes between. The tables end up equal to
the Parquet tables, so the SQL is the view's own query over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.engine import Engine
from driftwell.functions import values
from driftwell.operators.zset import W, negate, union, weighted
from driftwell.session import broadcast_if_small, work_path
from driftwell.sources.tables import day_of, table
from driftwell.streaming.adapter import capture

BUCKETS = 4
#: False values by column, as SQL or as columns.
Wrong = dict[str, str | Column]


def _history(df: DataFrame, wrong: Wrong) -> tuple[DataFrame, list[DataFrame]]:
    """(first rows, change batches) that end at *df*; *wrong* gives the false values of some first and some passing rows."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(10))
    rows = df.withColumn("__p", part)
    these = lambda *p: rows.where(F.col("__p").isin(*p)).drop("__p")
    false = lambda *p: these(*p).withColumns({c: F.expr(x) if isinstance(x, str) else x for c, x in wrong.items()})
    first = union(these(1, 2, 3, 4, 5, 6, 7), false(0))
    fixed = union(weighted(these(8)), weighted(false(0), -1), weighted(these(0)))
    passing = union(weighted(these(9)), weighted(false(1)))
    return first, [fixed, passing, weighted(false(1), -1)]


def _play(engine: Engine, name: str, df: DataFrame, wrong: Wrong) -> list[DataFrame]:
    """Creates the table with its first rows; gives the batches to apply."""
    first, batches = _history(df, wrong)
    engine.create_table(name, first)
    return batches


def _run(spark: SparkSession, tables: dict[str, tuple[DataFrame, Wrong]], sql: str) -> DataFrame:
    engine = Engine(spark, buckets=BUCKETS)
    batches = {name: _play(engine, name, df, wrong) for name, (df, wrong) in tables.items()}
    engine.create_view("v", sql)
    for name in tables:
        engine.apply(name, batches[name][0])
    engine.refresh("v")
    for name in tables:
        engine.apply(name, batches[name][1])
        engine.apply(name, batches[name][2])
    engine.refresh("v")
    return engine.table("v")


_ORDERS: Wrong = {"o_orderstatus": "'?'", "o_custkey": "o_custkey + 1000000", "o_totalprice": "o_totalprice * 1000"}
_ITEMS: Wrong = {"l_returnflag": "concat(l_returnflag, '?')", "l_quantity": "l_quantity + 0.125D"}
_EVENTS: Wrong = {"event_type": "'?'", "value": "value * -1e15D", "user_id": "user_id + 500"}
_CUSTOMERS: Wrong = {"c_mktsegment": "'?'"}


def _orders(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _run(spark, {"orders": (table(spark, d, "orders"), _ORDERS)}, sql)


def _items(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _run(spark, {"lineitem": (table(spark, d, "lineitem"), _ITEMS)}, sql)


def _events(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _run(spark, {"events": (table(spark, d, "events"), _EVENTS)}, sql)


def _rounded(query: Callable[[SparkSession, str], DataFrame], **digits: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: query(spark, d).withColumns({c: F.round(c, n) for c, n in digits.items()})


def _with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """events with NULLs: clicks without value, one user without id."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return events.withColumn("value", F.when(F.col("event_type") != "click", F.col("value"))).withColumn("user_id", F.when(F.col("user_id") != 7, F.col("user_id")))


_NULLS = "(SELECT event_id, nullif(user_id, 7) AS user_id, event_type, CASE WHEN event_type <> 'click' THEN value END AS value FROM events)"
_NULLS_WRONG: Wrong = {"event_type": "'?'", "value": "CAST(NULL AS DOUBLE)"}


def _nulls(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _run(spark, {"events_n": (_with_nulls(spark, d), _NULLS_WRONG)}, sql)


def _join(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return _run(spark, {"orders": (table(spark, d, "orders"), _ORDERS), "customer": (table(spark, d, "customer"), _CUSTOMERS)}, sql)


def null_key_join(spark: SparkSession, d: str) -> DataFrame:
    users = _with_nulls(spark, d).select("user_id").distinct().withColumn("tier", F.pmod(F.coalesce("user_id", F.lit(0)), F.lit(3)))
    users = users.unionByName(users.limit(0)).withColumnRenamed("user_id", "uid")
    return _run(spark, {"events_n": (_with_nulls(spark, d), _NULLS_WRONG), "users": (users, {"tier": F.lit(99).cast("bigint")})}, "SELECT tier, COUNT(*) AS n, COUNT(value) AS n_values FROM events_n JOIN users ON user_id = uid GROUP BY tier")


def update_moves_group(spark: SparkSession, d: str) -> DataFrame:
    """Orders change their status one after the other: update() with old and new rows."""
    orders = table(spark, d, "orders")
    early = orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.lit("O")).otherwise(F.col("o_orderstatus")))
    moved = orders.where(F.col("o_orderstatus") == "F")
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("orders", early)
    engine.create_view("v", "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderkey) AS mx FROM orders GROUP BY o_orderstatus")
    engine.update("orders", moved.withColumn("o_orderstatus", F.lit("O")), moved)
    engine.refresh("v")
    return engine.table("v")


def retract_last_row_of_group(spark: SparkSession, d: str) -> DataFrame:
    """A whole status is deleted, row by row, and must leave no group; then it comes back."""
    orders = table(spark, d, "orders")
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("orders", orders)
    engine.create_view("v", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
    engine.delete("orders", orders.where(F.col("o_orderstatus") == "P"))
    engine.refresh("v")
    gone = engine.table("v").select("o_orderstatus", "n", F.lit("without P").alias("step"))
    engine.insert("orders", orders.where(F.col("o_orderstatus") == "P"))
    engine.refresh("v")
    return gone.unionByName(engine.table("v").select("o_orderstatus", "n", F.lit("with P").alias("step")))


def extremum_retraction(spark: SparkSession, d: str) -> DataFrame:
    """The present extremes of every group are deleted; the next ones take their place."""
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    ends = events.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    gone = events.join(broadcast_if_small(ends), "event_type").where((F.col("value") == F.col("lo")) | (F.col("value") == F.col("hi"))).select(events.columns)
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("events", events)
    engine.create_view("v", "SELECT event_type, MIN(value) AS lo, MAX(value) AS hi, COUNT(*) AS n FROM events GROUP BY event_type")
    engine.delete("events", gone)
    engine.refresh("v")
    return engine.table("v")


def batch_invariance(spark: SparkSession, d: str) -> DataFrame:
    """All changes in one batch and in three with a refresh each: the difference of the two results must be empty, so both count once."""
    sql = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus"
    engine = Engine(spark, buckets=BUCKETS)
    batches = _play(engine, "lineitem", table(spark, d, "lineitem"), _ITEMS)
    engine.create_view("by_one", sql)
    engine.create_view("at_once", sql)
    for b in batches:
        engine.apply("lineitem", b)
        engine.refresh("by_one")
    engine.refresh("at_once")
    return engine.table("by_one").intersectAll(engine.table("at_once"))


def refresh_all(spark: SparkSession, d: str) -> DataFrame:
    """Three views over two tables, brought up to date in one commit."""
    engine = Engine(spark, buckets=BUCKETS)
    batches = {"orders": _play(engine, "orders", table(spark, d, "orders"), _ORDERS), "events": _play(engine, "events", table(spark, d, "events"), _EVENTS)}
    engine.create_view("a", "SELECT o_orderstatus AS k, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
    engine.create_view("b", "SELECT o_orderpriority AS k, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
    engine.create_view("c", "SELECT event_type AS k, COUNT(*) AS n FROM events GROUP BY event_type")
    for name, changes in batches.items():
        for b in changes:
            engine.apply(name, b)
    engine.refresh_all()
    engine.refresh_all("continue")
    return union(*[engine.table(v).withColumn("v", F.lit(v)) for v in "abc"])


def replace_capture(spark: SparkSession, d: str) -> DataFrame:
    """Customers are replaced by key: half of them first come with false values."""
    customers = table(spark, d, "customer")
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("customer", customers.withColumn("c_mktsegment", F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lit("?")).otherwise(F.col("c_mktsegment"))), unique=[["c_custkey"], ["c_name"]])
    engine.create_view("v", "SELECT c_mktsegment, COUNT(*) AS n, SUM(c_custkey) AS s FROM customer GROUP BY c_mktsegment")
    engine.replace("customer", customers)
    engine.refresh("v")
    return engine.table("v")


def replace_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Cells replaced by a dynamic unique key: 1.0 takes the place of 1, '1' stands beside it, and rows without key all stay."""
    events = table(spark, d, "events").select("event_id")
    n, none = F.col("event_id"), values.int_cell(F.lit(None).cast("bigint"))
    whole = lambda x: F.when(n % 4 < 2, values.int_cell(n)).when(n % 4 == 2, values.text_cell(n.cast("string"))).otherwise(x)
    real = F.when(n % 4 == 0, values.real_cell(n.cast("double"))).when(n % 4 == 2, values.int_cell(n)).otherwise(none)
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("cells", events.select(whole(none).alias("k"), F.lit("first").alias("came")), unique=[["k"]])
    engine.create_view("v", "SELECT came, COUNT(*) AS n, COUNT(k) AS n_keys FROM cells GROUP BY came")
    engine.replace("cells", events.where(n % 2 == 0).select(real.alias("k"), F.lit("second").alias("came")))
    engine.refresh("v")
    engine.delete("cells", engine.base("cells").where(F.col("k.c") == values.TEXT))
    engine.refresh("v")
    return engine.table("v")


def sum_cancels(spark: SparkSession, d: str) -> DataFrame:
    """Large doubles that cancel leave the exact sum of the small ones, unrounded; adding up in doubles would lose it."""
    events = table(spark, d, "events")
    large, small = F.col("user_id") * F.lit(2.0**70), F.floor(F.col("value") * 1024) / F.lit(1024.0)
    rows = union(*[events.select("event_id", F.lit(i).alias("part"), "event_type", x.alias("x")) for i, x in enumerate((large, small, -large))])
    return _run(spark, {"parts": (rows, {"x": "x * 3"})}, "SELECT event_type, SUM(x) AS s, TOTAL(x) AS t FROM parts GROUP BY event_type")


def blob_literal(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.encode("o_orderpriority", "UTF-8").alias("b"))
    return _run(spark, {"blobs": (orders, {"b": "unhex('FF')"})}, "SELECT b, COUNT(*) AS n FROM blobs WHERE b >= X'33' GROUP BY b").withColumn("b", F.decode("b", "UTF-8"))


def facts_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Measurements by kind and day, as a monitoring table is rolled up."""
    facts = table(spark, d, "events").select("event_id", "event_type", day_of("ts").alias("day"), "value")
    view = _run(spark, {"facts": (facts, {"value": "value + 1e12D", "day": "'?'"})}, "SELECT event_type, day, AVG(value) AS mean, MIN(value) AS lo, MAX(value) AS hi, COUNT(*) AS n FROM facts GROUP BY event_type, day")
    return view.withColumn("mean", F.round("mean", 6))


def open_lots(spark: SparkSession, d: str) -> DataFrame:
    """A join under IS NULL with a key that can be NULL: bids on auctions that were not deleted, by channel."""
    bid = table(spark, d, "bid").select("bid_id", "auction", "channel", "price", "ingest_time")
    lots = table(spark, d, "auction").select("id", "category", "deleted_at", "ingest_time")
    sql = "SELECT channel, COUNT(*) AS n, COUNT(price) AS n_priced, MAX(price) AS hi FROM bid JOIN auction ON bid.auction = auction.id WHERE deleted_at IS NULL GROUP BY channel"
    return _run(spark, {"bid": (bid, {"channel": "'?'", "auction": "auction + 1"}), "auction": (lots, {"deleted_at": "TIMESTAMP '2000-01-01'"})}, sql)


def session_spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last click and clicks of each user."""
    return _run(spark, {"events": (table(spark, d, "events"), _EVENTS)}, "SELECT user_id, MIN(ts) AS first_ts, MAX(ts) AS last_ts, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and counts by repository and language, both of which can be NULL."""
    docs = table(spark, d, "documents").select("doc_id", "repo", "lang", "n_chars", "n_files")
    return _run(spark, {"docs": (docs, {"n_chars": "n_chars * -7", "lang": "'?'"})}, "SELECT repo, lang, COUNT(*) AS n, SUM(n_chars) AS chars, SUM(n_files) AS files FROM docs WHERE n_chars >= 200 GROUP BY repo, lang")


def join_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """A join with several rows a key on one side, kept up through changes of either side and of both at once."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    sql = "SELECT o_orderpriority, COUNT(*) AS n, SUM(l_partkey) AS parts, SUM(l_linenumber) AS numbers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"
    engine = Engine(spark, buckets=BUCKETS)
    left, right = _play(engine, "lineitem", items, {"l_orderkey": "l_orderkey + 1", "l_partkey": "-l_partkey"}), _play(engine, "orders", orders, _ORDERS | {"o_orderpriority": "'?'"})
    engine.create_view("v", sql)
    engine.apply("lineitem", left[0])
    engine.refresh("v")
    engine.apply("orders", right[0])
    engine.refresh("v")
    for name, batches in (("lineitem", left), ("orders", right)):
        for b in batches[1:]:
            engine.apply(name, b)
    engine.refresh("v")
    return engine.table("v")


def gc_resume(spark: SparkSession, d: str) -> DataFrame:
    """The applied log is folded away and an engine reopened on the same folder goes on."""
    root = work_path(spark, "resumed")
    engine = Engine(spark, root, buckets=BUCKETS)
    batches = _play(engine, "orders", table(spark, d, "orders"), _ORDERS)
    engine.create_view("v", "SELECT o_orderpriority, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_orderkey) AS hi FROM orders GROUP BY o_orderpriority")
    engine.apply("orders", batches[0])
    engine.refresh("v")
    engine.compact("orders")
    engine.vacuum()
    again = Engine(spark, root)
    for b in batches[1:]:
        again.apply("orders", b)
    again.refresh("v")
    return again.table("v")


def last_changes(spark: SparkSession, d: str) -> DataFrame:
    """What one refresh took out of the output and put in."""
    orders = table(spark, d, "orders")
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("orders", orders.where(F.col("o_orderstatus") != "P"))
    engine.create_view("v", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
    engine.apply("orders", union(weighted(orders.where(F.col("o_orderstatus") == "P")), weighted(orders.where(F.col("o_orderstatus") == "F"), -1)))
    engine.refresh("v")
    return engine.last_changes("v").select("o_orderstatus", "n", F.col(W).alias("w"))


def dynamic_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cells of several storage classes under one key: 1 and 1.0 are one group, '1' another."""
    events = table(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(4)).alias("u"), F.pmod("event_id", F.lit(3)).alias("how"), "value")
    cell = F.when(F.col("how") == 0, values.int_cell(F.col("u"))).when(F.col("how") == 1, values.real_cell(F.col("u").cast("double"))).otherwise(values.text_cell(F.col("u").cast("string")))
    rows = events.select("event_id", cell.alias("k"), F.col("u").alias("v"))
    view = _run(spark, {"cells": (rows, {"k": values.text_cell(F.lit("?"))})}, "SELECT k, COUNT(*) AS n, SUM(v) AS s FROM cells GROUP BY k")
    return view.select(F.when(F.col("k.c") == values.TEXT, "text").otherwise("number").alias("class"), F.coalesce(F.col("k.t").cast("bigint"), F.col("k.i"), F.col("k.r").cast("bigint")).alias("k"), "n", "s")


def join_dynamic_keys(spark: SparkSession, d: str) -> DataFrame:
    """Integer and real keys that are equal as numbers join; text and NULL keys don't."""
    events = table(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(4)).alias("u"), F.pmod("event_id", F.lit(4)).alias("how"))
    u, how = F.col("u"), F.col("how")
    cell = F.when(how == 0, values.int_cell(u)).when(how == 1, values.real_cell(u.cast("double"))).when(how == 2, values.text_cell(u.cast("string"))).otherwise(values.int_cell(F.lit(None).cast("bigint")))
    names = spark.range(4).select(F.when(F.col("id") % 2 == 0, values.real_cell(F.col("id").cast("double"))).otherwise(values.int_cell(F.col("id"))).alias("nk"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    sql = "SELECT name, COUNT(*) AS n, MAX(event_id) AS hi FROM cells JOIN names ON k = nk GROUP BY name"
    return _run(spark, {"cells": (events.select("event_id", cell.alias("k")), {"event_id": "event_id + 1000000000"}), "names": (names, {"name": "'?'"})}, sql)


def sum_text(spark: SparkSession, d: str) -> DataFrame:
    """Text counts as the number it spells or begins with, 0 if none."""
    events = table(spark, d, "events")
    spelled = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), F.col("user_id"), F.lit(" "))).when(F.col("event_id") % 4 == 1, F.concat(F.col("user_id"), F.lit(".5x"))).when(F.col("event_id") % 4 == 2, F.lit("abc"))
    rows = events.select("event_id", "event_type", spelled.alias("t"))
    return _run(spark, {"texts": (rows, {"t": "'1e5'"})}, "SELECT event_type, SUM(t) AS s, TOTAL(t) AS tt, COUNT(t) AS n FROM texts GROUP BY event_type")


def infinite_sums(spark: SparkSession, d: str) -> DataFrame:
    """Infinities are counted beside the sum: one sign wins, both give NULL, and they retract."""
    events, inf = table(spark, d, "events"), F.lit(float("inf"))
    value = F.when((F.col("event_type") != "click") & (F.col("event_id") % 100 == 0), inf).when((F.col("event_type") == "purchase") & (F.col("event_id") % 100 == 1), -inf).otherwise(F.col("value"))
    view = _run(spark, {"events_i": (events.select("event_id", "event_type", value.alias("value")), {"value": "CAST('-Infinity' AS DOUBLE)"})}, "SELECT event_type, SUM(value) AS s, COUNT(value) AS n FROM events_i GROUP BY event_type")
    return view.withColumn("s", F.when(F.abs("s") == inf, F.signum("s") * 1e18).otherwise(F.round("s", 2)))


def m0_views(spark: SparkSession, d: str) -> DataFrame:
    """The workload of filtered views: SUM and COUNT by region above several limits, over one captured table."""
    orders = table(spark, d, "m0_orders")
    engine = Engine(spark, buckets=BUCKETS)
    batches = _play(engine, "orders", orders, {"region": F.lit("?"), "amount": F.col("amount") + 1})
    for limit in (0, 50, 100):
        engine.create_view(f"above_{limit}", f"SELECT region, SUM(amount) AS s, COUNT(*) AS n FROM orders WHERE amount > {limit} GROUP BY region")
    for b in batches:
        engine.apply("orders", b)
    engine.refresh_all()
    return union(*[engine.table(f"above_{x}").withColumn("above", F.lit(x).cast("bigint")) for x in (0, 50, 100)])


def m2a_replay(spark: SparkSession, d: str) -> DataFrame:
    """The skewed update log, replayed: base rows, then inserts, then amounts replaced by (cell, id)."""
    log = table(spark, d, "m2a_log")
    row = ["cell", "id", "g", "amount"]
    last = lambda df: df.groupBy("cell", "id").agg(F.max_by(F.struct("g", "amount"), "seq").alias("r")).select("cell", "id", "r.g", "r.amount")
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("log", log.where(F.col("op") == "base").select(row), unique=[["cell", "id"]])
    engine.create_view("v", "SELECT cell, g, COUNT(*) AS n, SUM(amount) AS s FROM log GROUP BY cell, g")
    engine.insert("log", log.where(F.col("op") == "insert").select(row))
    engine.replace("log", last(log.where(F.col("op") == "amount")))
    engine.refresh("v")
    return engine.table("v")


def stream_capture(spark: SparkSession, d: str) -> DataFrame:
    """A Parquet stream fills the change log in micro-batches; each refreshes the view."""
    source = work_path(spark, "stream_in")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(source)
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("events", events.schema)
    engine.create_view("v", "SELECT event_type, COUNT(*) AS n, MAX(event_id) AS last_id FROM events GROUP BY event_type")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    running = capture(engine, "events", stream, work_path(spark, "stream_checkpoint"), ["v"])
    running.awaitTermination()
    return engine.table("v")


def consolidated(spark: SparkSession, d: str) -> DataFrame:
    """A change log with rows inserted, deleted and corrected, consolidated to what it amounts to."""
    first, batches = _history(table(spark, d, "nation"), {"n_name": F.lit("?")})
    from driftwell.operators.zset import consolidate

    return consolidate(union(weighted(first), *batches)).withColumnRenamed(W, "w")


def net_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Changes that cancel out leave the output as it was, but are applied: the second refresh has nothing to do."""
    orders = table(spark, d, "orders")
    engine = Engine(spark, buckets=BUCKETS)
    engine.create_table("orders", orders)
    engine.create_view("v", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
    passing = weighted(orders.withColumn("o_orderstatus", F.lit("?")))
    engine.apply("orders", passing)
    engine.apply("orders", negate(passing))
    first, second = engine.refresh("v"), engine.refresh("v")
    return engine.table("v").withColumn("refreshed", F.lit(first)).withColumn("again", F.lit(second))


_STATUS = "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_custkey) AS s FROM orders WHERE {0} GROUP BY o_orderstatus"
_STATUS_SQL = "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE {0} GROUP BY o_orderstatus"
_FILTERS = {
    "filter_gt": "o_totalprice > 150000",
    "filter_ge": "o_custkey >= 700",
    "filter_lt": "o_totalprice < 123456.5",
    "filter_le": "o_custkey <= 700",
    "filter_eq": "o_orderpriority = '1-URGENT'",
    "filter_ne": "o_custkey <> 700",
    "literal_flip": "700 < o_custkey",
    "literal_negative": "o_custkey > -1.5",
    "literal_text_for_number": "o_custkey >= ' 700 '",
    "literal_other_class": "o_custkey < 'abc'",
}
_FILTER_SQL = _FILTERS | {"literal_text_for_number": "o_custkey >= 700", "literal_other_class": "o_custkey IS NOT NULL"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_group_count": _orders("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    **{name: _orders(_STATUS.format(where)) for name, where in _FILTERS.items()},
    "filter_is_null": _nulls("SELECT event_type, COUNT(*) AS n, COUNT(value) AS c FROM events_n WHERE value IS NULL GROUP BY event_type"),
    "filter_is_not_null": _nulls("SELECT event_type, COUNT(*) AS n, COUNT(value) AS c FROM events_n WHERE value IS NOT NULL GROUP BY event_type"),
    "null_group_key": _rounded(_nulls("SELECT user_id, COUNT(*) AS n, SUM(value) AS s, COUNT(value) AS c FROM events_n GROUP BY user_id"), s=2),
    "all_null_aggregate": _nulls("SELECT event_type, MIN(value) AS lo, MAX(value) AS hi, COUNT(value) AS c FROM events_n GROUP BY event_type"),
    "count_col": _nulls("SELECT event_type, COUNT(value) AS n, COUNT(user_id) AS u FROM events_n GROUP BY event_type"),
    "sum_int": _orders("SELECT o_orderpriority, SUM(o_custkey) AS s, SUM(o_orderkey) AS k FROM orders GROUP BY o_orderpriority"),
    "sum_real": _rounded(_items("SELECT l_returnflag, SUM(l_extendedprice) AS s, SUM(l_discount) AS t FROM lineitem GROUP BY l_returnflag"), s=2, t=2),
    "total": _rounded(_nulls("SELECT event_type, TOTAL(value) AS t FROM events_n GROUP BY event_type"), t=2),
    "avg": _rounded(_items("SELECT l_linestatus, AVG(l_quantity) AS a, AVG(l_partkey) AS p FROM lineitem GROUP BY l_linestatus"), a=6, p=6),
    "min": _events("SELECT event_type, MIN(value) AS lo, MIN(ts) AS first_ts, MIN(user_id) AS u FROM events GROUP BY event_type"),
    "max": _events("SELECT event_type, MAX(value) AS hi, MAX(ts) AS last_ts, MAX(user_id) AS u FROM events GROUP BY event_type"),
    "min_max_text": _orders("SELECT o_orderstatus, MIN(o_orderpriority) AS lo, MAX(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus"),
    "multi_key_group": _rounded(_items("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, MAX(l_shipdate) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus"), q=2),
    "many_groups": _rounded(_items("SELECT l_partkey, COUNT(*) AS n, SUM(l_extendedprice) AS s, MIN(l_quantity) AS lo FROM lineitem GROUP BY l_partkey"), s=2),
    "join_inner": lambda spark, d: _join(spark, d, "SELECT c_mktsegment, COUNT(*) AS n, SUM(o_orderkey) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "join_filter": lambda spark, d: _join(spark, d, "SELECT c.c_mktsegment AS seg, o.o_orderstatus AS st, COUNT(*) AS n, MAX(o.o_totalprice) AS hi FROM customer c INNER JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000 GROUP BY c.c_mktsegment, o.o_orderstatus"),
    "null_key_join": null_key_join,
    "retract_last_row_of_group": retract_last_row_of_group,
    "extremum_retraction": extremum_retraction,
    "update_moves_group": update_moves_group,
    "batch_invariance": _rounded(batch_invariance, s=2),
    "refresh_all": refresh_all,
    "replace_capture": replace_capture,
    "replace_dynamic": replace_dynamic,
    "sum_cancels": sum_cancels,
    "blob_literal": blob_literal,
    "facts_by_day": facts_by_day,
    "open_lots": open_lots,
    "session_spans": session_spans,
    "usage_totals": usage_totals,
    "join_maintenance": join_maintenance,
    "filter_ne_nulls": _nulls("SELECT event_type, COUNT(*) AS n, COUNT(user_id) AS c FROM events_n WHERE user_id <> 8 GROUP BY event_type"),
    "gc_resume": gc_resume,
    "last_changes": last_changes,
    "dynamic_keys": dynamic_keys,
    "join_dynamic_keys": join_dynamic_keys,
    "sum_text": sum_text,
    "infinite_sums": infinite_sums,
    "m0_views": m0_views,
    "m2a_replay": m2a_replay,
    "stream_capture": stream_capture,
    "consolidate": consolidated,
    "net_nothing": net_nothing,
}

SQL: dict[str, str] = {
    "scan_group_count": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    **{name: _STATUS_SQL.format(where) for name, where in _FILTER_SQL.items()},
    "filter_is_null": f"SELECT event_type, count(*) AS n, count(value) AS c FROM {_NULLS} WHERE value IS NULL GROUP BY 1",
    "filter_is_not_null": f"SELECT event_type, count(*) AS n, count(value) AS c FROM {_NULLS} WHERE value IS NOT NULL GROUP BY 1",
    "null_group_key": f"SELECT user_id, count(*) AS n, round(sum(value), 2) AS s, count(value) AS c FROM {_NULLS} GROUP BY 1",
    "all_null_aggregate": f"SELECT event_type, min(value) AS lo, max(value) AS hi, count(value) AS c FROM {_NULLS} GROUP BY 1",
    "count_col": f"SELECT event_type, count(value) AS n, count(user_id) AS u FROM {_NULLS} GROUP BY 1",
    "sum_int": "SELECT o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS s, CAST(sum(o_orderkey) AS BIGINT) AS k FROM orders GROUP BY 1",
    "sum_real": "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS s, round(sum(l_discount), 2) AS t FROM lineitem GROUP BY 1",
    "total": f"SELECT event_type, round(coalesce(sum(value), 0.0), 2) AS t FROM {_NULLS} GROUP BY 1",
    "avg": "SELECT l_linestatus, round(avg(l_quantity), 6) AS a, round(avg(l_partkey), 6) AS p FROM lineitem GROUP BY 1",
    "min": "SELECT event_type, min(value) AS lo, min(ts) AS first_ts, min(user_id) AS u FROM events GROUP BY 1",
    "max": "SELECT event_type, max(value) AS hi, max(ts) AS last_ts, max(user_id) AS u FROM events GROUP BY 1",
    "min_max_text": "SELECT o_orderstatus, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY 1",
    "multi_key_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, max(l_shipdate) AS d FROM lineitem GROUP BY 1, 2",
    "many_groups": "SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s, min(l_quantity) AS lo FROM lineitem GROUP BY 1",
    "join_inner": "SELECT c_mktsegment, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "join_filter": "SELECT c_mktsegment AS seg, o_orderstatus AS st, count(*) AS n, max(o_totalprice) AS hi FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2",
    "null_key_join": f"SELECT tier, count(*) AS n, count(value) AS n_values FROM {_NULLS} e JOIN (SELECT DISTINCT user_id AS uid, coalesce(user_id, 0) % 3 AS tier FROM {_NULLS}) u ON user_id = uid GROUP BY 1",
    "retract_last_row_of_group": "SELECT o_orderstatus, count(*) AS n, 'with P' AS step FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*), 'without P' FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "extremum_retraction": "SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM (SELECT *, min(value) OVER w AS a, max(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)) WHERE value <> a AND value <> z GROUP BY 1",
    "update_moves_group": "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderkey) AS mx FROM orders GROUP BY 1",
    "batch_invariance": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1, 2",
    "refresh_all": "SELECT o_orderstatus AS k, count(*) AS n, 'a' AS v FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), 'b' FROM orders GROUP BY 1 UNION ALL SELECT event_type, count(*), 'c' FROM events GROUP BY 1",
    "replace_capture": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer GROUP BY 1",
    "gc_resume": "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1",
    "last_changes": "SELECT o_orderstatus, count(*) AS n, CAST(CASE o_orderstatus WHEN 'P' THEN 1 ELSE -1 END AS BIGINT) AS w FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY 1",
    "dynamic_keys": "SELECT CASE WHEN event_id % 3 = 2 THEN 'text' ELSE 'number' END AS class, user_id % 4 AS k, count(*) AS n, CAST(sum(user_id % 4) AS BIGINT) AS s FROM events GROUP BY 1, 2",
    "join_dynamic_keys": "SELECT 'n' || (user_id % 4) AS name, count(*) AS n, max(event_id) AS hi FROM events WHERE event_id % 4 < 2 GROUP BY 1",
    "sum_text": "SELECT event_type, sum(t) AS s, coalesce(sum(t), 0.0) AS tt, count(t) AS n FROM (SELECT event_type, CAST(CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id + 0.5 WHEN 2 THEN 0 END AS DOUBLE) AS t FROM events) GROUP BY 1",
    "infinite_sums": "SELECT event_type, CASE WHEN up AND down THEN NULL WHEN up THEN 1e18 WHEN down THEN -1e18 ELSE s END AS s, n FROM (SELECT event_type, bool_or(event_type <> 'click' AND event_id % 100 = 0) AS up, bool_or(event_type = 'purchase' AND event_id % 100 = 1) AS down, round(sum(value), 2) AS s, count(*) AS n FROM events GROUP BY 1)",
    "m0_views": " UNION ALL ".join(f"SELECT region, CAST(sum(amount) AS BIGINT) AS s, count(*) AS n, CAST({x} AS BIGINT) AS above FROM m0_orders WHERE amount > {x} GROUP BY 1" for x in (0, 50, 100)),
    "m2a_replay": "SELECT cell, g, count(*) AS n, CAST(sum(amount) AS BIGINT) AS s FROM (SELECT * FROM m2a_log QUALIFY row_number() OVER (PARTITION BY cell, id ORDER BY seq DESC) = 1) GROUP BY 1, 2",
    "stream_capture": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
    "consolidate": "SELECT *, CAST(1 AS BIGINT) AS w FROM nation",
    "net_nothing": "SELECT o_orderstatus, count(*) AS n, true AS refreshed, false AS again FROM orders GROUP BY 1",
    "replace_dynamic": "SELECT 'first' AS came, count(*) AS n, count(CASE WHEN event_id % 4 = 1 THEN 1 END) AS n_keys FROM events WHERE event_id % 4 IN (1, 3) UNION ALL SELECT 'second', count(*), count(*) FROM events WHERE event_id % 2 = 0",
    "sum_cancels": "SELECT event_type, sum(floor(value * 1024)) / 1024.0 AS s, sum(floor(value * 1024)) / 1024.0 AS t FROM events GROUP BY 1",
    "blob_literal": "SELECT o_orderpriority AS b, count(*) AS n FROM orders WHERE encode(o_orderpriority) >= '\\x33'::BLOB GROUP BY 1",
    "facts_by_day": "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1, 2",
    "open_lots": "SELECT channel, count(*) AS n, count(price) AS n_priced, max(price) AS hi FROM bid JOIN auction ON bid.auction = auction.id WHERE deleted_at IS NULL GROUP BY 1",
    "session_spans": "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1",
    "usage_totals": "SELECT repo, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(n_files) AS BIGINT) AS files FROM documents WHERE n_chars >= 200 GROUP BY 1, 2",
    "join_maintenance": "SELECT o_orderpriority, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "filter_ne_nulls": f"SELECT event_type, count(*) AS n, count(user_id) AS c FROM {_NULLS} WHERE user_id <> 8 GROUP BY 1",
}
