"""Versioned tables: appended row versions of which the latest of each key counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: Sequence[str], *version: str) -> DataFrame:
    """The row with the greatest version columns of each key. Filters on key columns go below the window, and the
    rank condition becomes a group limit before the shuffle."""
    order = [F.col(v).desc_nulls_last() for v in version]
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank_ = 1").drop("rank_")


def with_column_default(df: DataFrame, name: str, value: object, kind: str) -> DataFrame:
    """The table with a column that older data lacks."""
    return df if name in df.columns else df.withColumn(name, F.lit(value).cast(kind))


def month_partition(df: DataFrame, day: str) -> DataFrame:
    """Adds the partition column yyyymm; readers that filter by day should filter by it too, to prune folders."""
    return df.withColumn("yyyymm", F.date_format(day, "yyyyMM").cast("int"))


def on_day(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows of a day; where the table is partitioned by month, of that folder only."""
    out = df.where(F.col(column) == F.lit(day).cast("date"))
    return out.where(F.col("yyyymm") == F.date_format(F.lit(day).cast("date"), "yyyyMM").cast("int")) if "yyyymm" in df.columns else out
