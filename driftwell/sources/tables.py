"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(column: Column | str) -> Column:
    """A name as it is compared: trimmed of spaces, lower case, blank as NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def day_of(column: Column | str) -> Column:
    """YYYY-MM-DD of a timestamp."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("date").cast("string")
