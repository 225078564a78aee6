"""Most frequent values by a three-phase threshold top-k over local counts.

Rows are dealt to nodes by the hash of their id, so repeated deliveries of a row meet on one node and count once, and each
node counts its values (as 64-bit hashes) without a further shuffle. The local counts are written; then

1. each node's k leaders are exchanged and added up; the k-th largest partial sum T is a lower bound of the k-th count
   (a wanted least count raises T),
2. values with a local count of at least T / nodes are fetched: a value below that on every node stays below T. Of those,
   values whose partial sum plus T / nodes for every node that didn't report them is below T are dropped,
3. the remaining candidates are counted exactly over all nodes.

Only candidates travel, of which there are at most nodes * rows / T. Hashes are resolved to values in the end, by one pass
over the source that keeps the candidates only; should two values share a hash, they are recounted by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import broadcast_if_small, partitions_for, written


def _stacked(rows: DataFrame, fields: list[str], prefix: str, out: str) -> DataFrame:
    """One row per field: the columns of *rows* that aren't *prefix*.., field, *out*."""
    rest = [c for c in rows.columns if not c.startswith(prefix)]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{prefix}{i}").alias(out)) for i, f in enumerate(fields)])
    return rows.select(*rest, F.inline(each))


def local_counts(df: DataFrame, row_id: Column, fields: dict[str, Column], nodes: int | None = None) -> DataFrame:
    """Written table node, field, h, c: rows per node, field and value hash; h is NULL for rows without value."""
    n = nodes or partitions_for(df)
    rows = df.select(row_id.alias("__id"), *[F.when(c.isNotNull(), F.xxhash64(c)).alias(f"__h{i}") for i, c in enumerate(fields.values())])
    dealt = rows.withColumn("node", F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int")).repartitionById(n, F.col("node"))
    once = dealt.dropDuplicates()
    counts = _stacked(once.drop("__id"), list(fields), "__h", "h").groupBy("node", "field", "h").agg(F.count(F.lit(1)).alias("c"))
    return written(counts, "local_counts")


def most_frequent(df: DataFrame, row_id: Column, fields: dict[str, Column], k: int, min_share: float = 0.0, nodes: int | None = None) -> DataFrame:
    """The *k* most frequent values of each field that hold at least *min_share* of all rows: field, item, n_rows, of_rows.

    n_rows is exact; of several values with the k-th count the smallest are kept. *fields* are string columns; rows of one
    *row_id* agree in them and count once. NULL is no value, but its row counts in of_rows. An empty table gives no row.
    """
    names = list(fields)
    m = nodes or partitions_for(df)
    local = local_counts(df, row_id, fields, m)
    total = local.where(F.col("field") == names[0]).agg(F.sum("c")).first()[0] or 0
    least = max(1, -(-int(total * min_share * 10**9) // 10**9))
    valued = local.where(F.col("h").isNotNull())

    # phase 1
    by_count = Window.partitionBy("node", "field").orderBy(F.col("c").desc(), "h")
    leaders = valued.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= k)
    partial = leaders.groupBy("field", "h").agg(F.sum("c").alias("s"))
    ranked = partial.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.col("s").desc(), "h"))).where(F.col("r") <= k)
    bounds = {r["field"]: r["t"] for r in ranked.groupBy("field").agg(F.min("s").alias("t"), F.count(F.lit(1)).alias("n")).collect() if r["n"] == k}
    limits = {f: max(least, bounds.get(f, 1)) for f in names}
    resolved, shared = _settled(df, row_id, fields, valued, limits, m)
    if shared:  # sums of values that share a hash may have set the bound too high
        kth = _ranked(resolved, k).groupBy("field").agg(F.min("n_rows").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        exact = {r["field"]: r["t"] for r in kth if r["n"] == k}
        lower = {f: max(least, min(limits[f], exact.get(f, 1))) for f in names}
        if lower != limits:
            resolved, _ = _settled(df, row_id, fields, valued, lower, m)
    top = _ranked(resolved.where(F.col("n_rows") >= F.lit(least)), k)
    return top.select("field", "item", "n_rows", F.lit(total).cast("long").alias("of_rows"))


def _ranked(resolved: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("field").orderBy(F.col("n_rows").desc(), "item")
    return resolved.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def _settled(df: DataFrame, row_id: Column, fields: dict[str, Column], valued: DataFrame, limits: dict[str, int], m: int) -> tuple[DataFrame, bool]:
    """Phases 2 and 3 for given bounds: field, h, item, n_rows of every value that may reach them; whether values share a hash."""
    names = list(fields)
    limit = F.create_map(*[x for f in names for x in (F.lit(f), F.lit(limits[f]))])[F.col("field")]

    # phase 2
    fetched = valued.where(F.col("c") * m >= limit).groupBy("field", "h").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("seen"))
    candidates = fetched.where(F.col("s") * m + (F.lit(m) - F.col("seen")) * limit >= limit * m).select("field", "h")

    # phase 3
    candidates = broadcast_if_small(written(candidates, "candidates"))
    exact = valued.join(candidates, ["field", "h"]).groupBy("field", "h").agg(F.sum("c").alias("n_rows")).where(F.col("n_rows") >= limit)
    exact = written(exact, "frequent_hashes")

    # values of the hashes
    source = df.select(row_id.alias("__id"), *[c.alias(f"__v{i}") for i, c in enumerate(fields.values())])
    values = _stacked(source, names, "__v", "item").where(F.col("item").isNotNull()).withColumn("h", F.xxhash64("item"))
    found = values.select("field", "h", "item").join(broadcast_if_small(exact), ["field", "h"])
    resolved = written(found.groupBy("field", "h", "item").agg(F.first("n_rows").alias("n_rows")), "frequent_values")
    shared = resolved.groupBy("field", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("field", "h")
    if not shared.limit(1).count():
        return resolved, False
    again = values.join(broadcast_if_small(shared), ["field", "h"]).select("__id", "field", "h", "item").dropDuplicates()
    recounted = again.groupBy("field", "h", "item").agg(F.count(F.lit(1)).alias("n_rows"))
    return resolved.join(shared, ["field", "h"], "left_anti").unionByName(recounted), True
