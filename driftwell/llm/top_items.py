"""The N highest-scoring items of every group by statistics-guided skipping.

The items are clustered by group into files: range-partitioned and sorted by group, falling score and the tie columns, in
row groups of few rows. A group of any size thus spreads over as many files as it fills, and footers name the least and
greatest group and score of each row group. Skipping happens twice:

* From the footers alone, over all files: a row group of one group with at least N rows proves that the group's N-th score is
  no lower than the least score in it. Row groups of that group whose greatest score lies strictly below the best such bound
  are never read, and files without any other row group are never opened again.
* Within a file, read by one task in falling greatest score: a row group of one group is skipped once its greatest score
  lies strictly below that group's current N-th score.

A row group with several groups is always read: it holds the first, best rows of all its groups but the least. A group wholly
inside one row group is settled when that is read; only groups that touch a row group's edge are kept, with N items each. At
most N items per group and file are merged in the end.

The order is total: score from the highest, then the tie columns from the lowest with NULL last, so repeated rows of one
item are equal and count once.

The work folder must be on a file system that pyarrow opens as well (local, hdfs, s3 or s3a, gs, abfs).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftwell.session import broadcast_if_small, file_system, partitions_for, with_package, work_path, written

#: Rows of a row group: the unit that is read or skipped.
ROW_GROUP_ROWS = 8192
#: What Hadoop calls a store that pyarrow knows under another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def clustered(df: DataFrame, group: Column, score: Column, ties: dict[str, Column], partitions: int | None = None, row_group_rows: int = ROW_GROUP_ROWS) -> str:
    """Folder of the distinct (group, score, ties) rows, clustered by group; rows without group or score (NULL, NaN) are left out."""
    rows = df.select(group.alias("__group"), score.alias("__score"), *[c.alias(f"__t{i}") for i, c in enumerate(ties.values())])
    rows = rows.where(F.col("__group").isNotNull() & F.col("__score").isNotNull())
    if dict(rows.dtypes)["__score"] in ("double", "float"):
        rows = rows.where(~F.isnan("__score"))
    order = [F.col("__group").asc(), F.col("__score").desc(), *[F.col(c).asc_nulls_last() for c in rows.columns[2:]]]
    # equal rows fall into the same range, so dropping repeats needs no further shuffle
    placed = rows.repartitionByRange(partitions or partitions_for(df), *order).dropDuplicates().sortWithinPartitions(*order)
    path = work_path(df.sparkSession, "clustered")
    placed.write.option("parquet.block.row.count.limit", row_group_rows).parquet(path)
    return path


def open_file(name: str) -> pa.NativeFile:
    """A file by its Hadoop name."""
    scheme, _, rest = name.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    source, inside = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    return source.open_input_file(inside)


def _row_groups(file: pq.ParquetFile) -> list[tuple]:
    """(greatest score, least group, greatest group, index, least score, rows) of each row group, None where a statistic is missing."""
    found = []
    meta = file.metadata
    place = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
    for i in range(meta.num_row_groups):
        g, s = (meta.row_group(i).column(place[c]).statistics for c in ("__group", "__score"))
        known = g is not None and g.has_min_max and s is not None and s.has_min_max
        found.append((s.max, g.min, g.max, i, s.min, meta.row_group(i).num_rows) if known else (None, None, None, i, None, meta.row_group(i).num_rows))
    return found


def top_of_file(file: pq.ParquetFile, n: int, only: set[int] | None = None) -> Iterator[tuple[pa.Table | None, int]]:
    """(rows that may be among the top *n* of their group or None, row groups skipped) in steps, for one clustered file.

    *only* names the row groups that the footers did not rule out.
    """
    groups = [x for x in _row_groups(file) if only is None or x[3] in only]
    known = all(x[0] is not None for x in groups)
    if known:
        groups.sort(key=lambda x: x[0], reverse=True)
    kept: dict = {}

    def key(row: tuple) -> tuple:
        return (-row[1], *[(x is None, x if x is not None else 0) for x in row[2:]])

    for greatest, least_group, greatest_group, index, _, _ in groups:
        held = kept.get(least_group) if known and least_group == greatest_group else None
        if held is not None and len(held) >= n and held[n - 1][1] > greatest:
            yield None, 1
            continue
        table = file.read_row_group(index).combine_chunks()
        group = table.column("__group").combine_chunks()
        size = len(group)
        starts = [0]
        if size > 1:
            starts += [x + 1 for x in pc.indices_nonzero(pc.not_equal(group[1:], group[:-1])).to_pylist()]
        ends = [*starts[1:], size]
        inner = [i for a, b in list(zip(starts, ends))[1:-1] for i in range(a, min(a + n, b))]
        if inner:
            yield table.take(pa.array(inner)), 0
        for a, b in {(starts[0], ends[0]), (starts[-1], ends[-1])}:  # these groups may go on in other row groups
            rows = [tuple(r.values()) for r in table.slice(a, min(n, b - a)).to_pylist()]
            kept[rows[0][0]] = sorted({*kept.get(rows[0][0], ()), *rows}, key=key)[:n]
    left = [r for rows in kept.values() for r in rows]
    if left:
        schema = file.schema_arrow
        yield pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*left), schema.types)], schema=schema), 0


def footers(spark: SparkSession, path: str) -> DataFrame:
    """Written table of all row groups below *path*: file, row_group, n_rows, least and greatest group and score."""
    kept = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    fs, at = file_system(spark, path)
    files = [str(s.getPath()) for s in fs.listStatus(at) if str(s.getPath()).endswith(".parquet")]  # one per partition
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("row_group", T.IntegerType()), T.StructField("n_rows", T.LongType())])
    for name, kind in (("least_group", "__group"), ("greatest_group", "__group"), ("least_score", "__score"), ("greatest_score", "__score")):
        schema = schema.add(name, kept[kind])
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_file(name) as opened:
                    found = [(name, i, rows, lo, hi, s_lo, s_hi) for s_hi, lo, hi, i, s_lo, rows in _row_groups(pq.ParquetFile(opened))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), arrow.types)] if found else [pa.array([], t) for t in arrow.types], schema=arrow)

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return written(with_package(listed).mapInArrow(task, schema), "footers")


def unskipped(found: DataFrame, n: int) -> DataFrame:
    """Row groups of footers() that may hold one of the top *n* items of a group."""
    alone = F.col("least_group") == F.col("greatest_group")
    bounds = found.where(alone & (F.col("n_rows") >= n)).groupBy(F.col("least_group").alias("__of")).agg(F.max("least_score").alias("__bound"))
    bounds = broadcast_if_small(written(bounds, "score_bounds"))
    below = alone & (F.col("greatest_score") < F.col("__bound"))
    return found.join(bounds, F.col("least_group") == F.col("__of"), "left").where(~F.coalesce(below, F.lit(False))).select(*found.columns)


def _scanned(df: DataFrame, group: Column, score: Column, ties: dict[str, Column], n: int, partitions: int | None, row_group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(candidates with one row of counts per file, footers): the rows of counts have no group but __read and __skipped."""
    spark = df.sparkSession
    path = clustered(df, group, score, ties, partitions, row_group_rows)
    found = footers(spark, path)
    rows = spark.read.parquet(path).schema
    schema = T.StructType([*rows.fields, T.StructField("__read", T.LongType()), T.StructField("__skipped", T.LongType())])
    arrow, own = to_arrow_schema(schema), to_arrow_schema(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                skipped = 0
                with open_file(name) as opened:
                    for table, unread in top_of_file(pq.ParquetFile(opened), n, set(wanted)):
                        skipped += unread
                        if table is not None:
                            for part in table.cast(own).to_batches():
                                none = pa.nulls(part.num_rows, pa.int64())
                                yield pa.RecordBatch.from_arrays([*part.columns, none, none], schema=arrow)
                counts = [pa.nulls(1, t) for t in own.types] + [pa.array([x], pa.int64()) for x in (len(wanted) - skipped, skipped)]
                yield pa.RecordBatch.from_arrays(counts, schema=arrow)

    plan = unskipped(found, n).groupBy("file").agg(F.collect_list("row_group").alias("wanted"))
    return with_package(plan).repartition(partitions or partitions_for(df)).mapInArrow(task, schema), found


def top_items(df: DataFrame, group: Column, score: Column, ties: dict[str, Column], n: int, group_name: str = "group", score_name: str = "score", partitions: int | None = None, row_group_rows: int = ROW_GROUP_ROWS) -> DataFrame:
    """The first *n* items of each group: *group_name*, rank_no (1..n), *score_name* and the tie columns under their names.

    Groups with fewer items give what they have; an empty table gives no row; other columns of *df* play no part.
    """
    scanned, _ = _scanned(df, group, score, ties, n, partitions, row_group_rows)
    best = scanned.where(F.col("__group").isNotNull()).drop("__read", "__skipped")
    order = [F.col("__score").desc(), *[F.col(c).asc_nulls_last() for c in best.columns[2:]]]
    ranked = best.withColumn("rank_no", F.row_number().over(Window.partitionBy("__group").orderBy(*order)).cast("long")).where(F.col("rank_no") <= n)
    return ranked.select(F.col("__group").alias(group_name), "rank_no", F.col("__score").alias(score_name), *[F.col(f"__t{i}").alias(c) for i, c in enumerate(ties)])


def skipping_report(df: DataFrame, group: Column, score: Column, ties: dict[str, Column], n: int, partitions: int | None = None, row_group_rows: int = ROW_GROUP_ROWS) -> DataFrame:
    """One row on what top_items() reads for the same arguments: n_items, row_groups, read, skipped_by_footer, skipped_in_file."""
    scanned, found = _scanned(df, group, score, ties, n, partitions, row_group_rows)
    counts = scanned.where(F.col("__group").isNull()).select(F.lit(0).alias("n"), F.lit(0).alias("all"), F.col("__read").alias("read"), F.col("__skipped").alias("skipped"))
    both = counts.unionByName(found.select(F.col("n_rows").alias("n"), F.lit(1).alias("all"), F.lit(0).alias("read"), F.lit(0).alias("skipped")))
    whole = both.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(y) for x, y in (("n", "n_items"), ("all", "row_groups"), ("read", "read"), ("skipped", "skipped_in_file"))])
    return whole.select("n_items", "row_groups", "read", (F.col("row_groups") - F.col("read") - F.col("skipped_in_file")).alias("skipped_by_footer"), "skipped_in_file")
