"""Versioned tables on disk: appended rows, monthly folders, migrations, and the small files around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taktwerk.operators.operations import unapplied
from taktwerk.operators.versioned import latest_version, month_partition, with_column_default

MIGRATIONS = T.StructType([T.StructField("id", T.StringType()), T.StructField("file", T.StringType()), T.StructField("checksum", T.StringType()), T.StructField("applied_at", T.TimestampType())])


def append(df: DataFrame, path: str, day: str | None = None) -> None:
    """Adds row versions; an update is a newer row. Facts go to monthly folders, sorted so that row groups can be skipped;
    rows are dealt by ranges of days and a hash, so that a large month is written by several tasks."""
    if day is None:
        df.write.mode("append").parquet(path)
    else:
        month_partition(df, day).repartitionByRange("yyyymm", day, F.xxhash64(*df.columns)).sortWithinPartitions("yyyymm", day).write.mode("append").partitionBy("yyyymm").parquet(path)


def read_latest(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], *version: str) -> DataFrame:
    """The merged view of a versioned table. Columns that older files lack are null, and 0 for the cancelled flag."""
    df = spark.read.schema(schema).parquet(path)
    df = with_column_default(df, "faelltaus", 0, "smallint") if "fahrzeugnummer" in df.columns else df
    return latest_version(df, key, *version)


def migrate(spark: SparkSession, path: str, steps: Sequence[tuple[str, str, Callable[[SparkSession], None]]]) -> list[str]:
    """Applies the steps (id, body, function) that the table at ``path`` does not list yet, in order of id, and records each."""
    spark.createDataFrame([], MIGRATIONS).write.mode("append").parquet(path)
    applied = latest_version(spark.read.schema(MIGRATIONS).parquet(path), ["id"], "applied_at")
    if len({i for i, _, _ in steps}) != len(steps):
        raise ValueError("two migrations have one id")
    todo = unapplied([(i, body) for i, body, _ in steps], applied.select("id")).collect()  # as many as there are steps
    run = {i: f for i, _, f in steps}
    for row in todo:
        run[row["id"]](spark)
        spark.createDataFrame([(row["id"], row["id"], row["checksum"])], "id string, file string, checksum string").withColumn("applied_at", F.current_timestamp()).write.mode("append").parquet(path)
    return [r["id"] for r in todo]


def write_line_order(order: DataFrame, path: str) -> None:
    """JSON rows (line, richtung, stops in order)."""
    lists = order.groupBy("linienname", "richtung").agg(F.array_sort(F.collect_list(F.struct("pos", "vgnkennung"))).alias("s"))
    lists.select("linienname", "richtung", F.transform("s", lambda x: x["vgnkennung"]).alias("stops")).write.mode("overwrite").json(path)


def read_line_order(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("linienname string, richtung tinyint, stops array<int>").json(path)
    return rows.select("linienname", "richtung", F.posexplode("stops").alias("pos", "vgnkennung")).withColumn("pos", F.col("pos") + 1)


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Points (line, route, pos, latitude, longitude) of JSON rows (line, coordinates) with one or several line strings.

    Coordinates are [longitude, latitude]; whether they nest once or twice is told by the text.
    """
    raw = spark.read.schema("line string, coordinates string").json(path)
    one = F.from_json("coordinates", "array<array<double>>")
    many = F.from_json("coordinates", "array<array<array<double>>>")
    nested = F.regexp_replace("coordinates", r"\s", "").startswith("[[[")
    routes = raw.select("line", F.posexplode(F.when(nested, many).otherwise(F.array(one))).alias("route", "points")).where("points is not null")
    return routes.select("line", "route", F.posexplode("points").alias("pos", "p")).select("line", "route", "pos", F.get("p", F.lit(1)).alias("latitude"), F.get("p", F.lit(0)).alias("longitude"))


def dead_letters(failed: DataFrame, reason: str, path: str) -> None:
    """Keeps rows that could not be handled, as JSON, with the reason and the time."""
    failed.select(F.lit(reason).alias("reason"), F.current_timestamp().alias("failed_at"), F.to_json(F.struct("*")).alias("row")).write.mode("append").parquet(path)
