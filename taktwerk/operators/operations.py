"""Metrics, traces, limits, observations and vehicle features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.text import first_filled


def window_rates(points: DataFrame, key: str, ts: str, value: str, seconds: int = 2) -> DataFrame:
    """Points, points a second (two decimals) and mean value (whole) by key and tumbling window."""
    w = F.window(F.col(ts), f"{seconds} seconds")
    rows = points.groupBy(key, w).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.select(key, F.col("window.start").alias("window_start"), "n", F.round(F.col("n") / seconds, 2).alias("rate"), F.round("mean", 0).alias("average"))


def status_counts(points: DataFrame, key: str, code: Column) -> DataFrame:
    return points.groupBy(key, code.alias("code")).agg(F.count("*").alias("n"))


def retained(log: DataFrame, ts: str, size: str, key: str, newest: Column, hours: int = 24, most_bytes: int = 1 << 30) -> DataFrame:
    """The newest entries of so many hours whose bytes fit. Hours are summed first, so that the running sum of a long
    log is taken within an hour, and over hours that are few."""
    rows = log.where(F.col(ts) >= newest - F.expr(f"interval {hours} hours")).withColumn("hour_", F.date_trunc("hour", F.col(ts)))
    later = rows.groupBy("hour_").agg(F.sum(size).alias("b")).withColumn("later_", F.coalesce(F.sum("b").over(Window.orderBy(F.desc("hour_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("b")
    within = F.sum(size).over(Window.partitionBy("hour_").orderBy(F.desc(ts), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(later, "hour_").withColumn("bytes_", F.col("later_") + within).where(F.col("bytes_") <= most_bytes).drop("hour_", "later_", "bytes_")


def limited(calls: DataFrame, key: str, ts_ms: str, cost: str, a_minute: float = 10.0, undrained: bool = False) -> DataFrame:
    """(key, ts_ms, cost, level, blocked, retry_ms): a leaky counter of each key that drains ``a_minute`` by the minute.

    A call passes while the drained level and its cost stay below the capacity, which is what drains in a minute; with
    ``undrained`` the level of the last call decides, as before anything drained. A call whose cost is null only asks:
    it is blocked if the drained level leaves no room for a call of one, and it adds nothing; of an unknown key it is
    not. ``retry_ms`` is when a blocked call may come back: what the level has above that room, in whole milliseconds of
    draining (below 0 where a dearer call was blocked by its cost), else null. A late call drains nothing. Each call
    depends on all before it, so a key is folded in order; a task streams its sorted keys and holds one level.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = level = last = None
        for batch in batches:
            df = batch.to_pandas()
            levels, blocked, retry = [], [], []
            for k, t, c in zip(df[key], df[ts_ms], df[cost]):
                asks = pd.isna(c)
                if k != at:
                    at, level, last = k, None, t
                t = max(t, last)
                drained = 0.0 if level is None else level - (t - last) / 60_000 * a_minute
                if level is None:
                    stop = False
                elif asks:
                    stop = max(0.0, drained) >= a_minute - 1
                else:
                    stop = (level if undrained else drained) + c >= a_minute
                if level is not None or not asks:
                    level, last = max(0.0, drained) + (0.0 if stop or asks else float(c)), t
                levels.append(level)
                blocked.append(stop)
                retry.append(round((level - (a_minute - 1)) / a_minute * 60_000) if stop else None)
            out = df.assign(level=pd.Series(levels, dtype="float64"), blocked=pd.Series(blocked, dtype="bool"), retry_ms=pd.array(retry, dtype="Int64"))
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    rows = calls.select(key, ts_ms, F.col(cost).cast("double").alias(cost)).repartition(key).sortWithinPartitions(key, ts_ms, cost)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(fold, f"{key} {kinds[key]}, {ts_ms} {kinds[ts_ms]}, {cost} double, level double, blocked boolean, retry_ms bigint")


def exposition(metrics: DataFrame) -> DataFrame:
    """Lines of the text format of metrics (name, help, kind, value): help, type and value of each."""
    lines = F.array(F.concat_ws(" ", F.lit("# HELP"), "name", "help"), F.concat_ws(" ", F.lit("# TYPE"), "name", "kind"), F.concat_ws(" ", "name", F.col("value").cast("string")))
    return metrics.select("name", F.posexplode(lines).alias("pos", "line"))


def call_durations(trace: DataFrame) -> DataFrame:
    """Requests beside their responses: (request_id, duration_us), null while no response came."""
    ends = trace.groupBy("request_id").agg(F.min(F.when(F.col("phase") == "request", F.col("ts_us"))).alias("a"), F.max(F.when(F.col("phase") == "response", F.col("ts_us"))).alias("b"))
    return ends.select("request_id", (F.col("b") - F.col("a")).alias("duration_us"))


def features(vehicles: DataFrame, info: Column, product: Column) -> DataFrame:
    """What a vehicle's free-form data says: air conditioning (known for some tram types), fuel, wheelchair spaces, accessible doors."""
    kind = F.lower(F.trim(F.coalesce(first_filled(info, "typ", "Fahrzeugtyp", "Name"), F.lit(""))))
    cooled = F.when((product == "Tram") & (kind.contains("gta8") | kind.contains("avenio")), F.lit("Vollklima"))
    doors = F.least(F.greatest(F.coalesce(first_filled(info, "anzahl_tueren", "AnzahlTueren").try_cast("int"), F.lit(0)), F.lit(0)), F.lit(12))
    wide = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: (i <= doors) & F.coalesce(F.element_at(info, F.concat(F.lit("tuer_"), i.cast("string"), F.lit("_mit_aufstellflaeche"))).isin("ja", "true"), F.lit(False)))
    return vehicles.select(
        "*", F.coalesce(first_filled(info, "Klimatisierung"), cooled).alias("air_conditioning"), first_filled(info, "Kraftstoffart").alias("fuel_type"),
        first_filled(info, "Rollstuhlplaetze", "Rollstuhlplatze").alias("wheelchair_spaces"), F.nullif(F.size(wide), F.lit(0)).alias("accessible_doors"),
    )


def latest_observation(observations: DataFrame, device: str | None = None) -> DataFrame:
    """The newest observation, of one device where given."""
    rows = observations if not device else observations.where(F.col("device") == device)
    return rows.orderBy(F.desc("ingested_at"), F.desc("timestamp"), "device").limit(1)


def unapplied(known: Sequence[tuple[str, str]], applied: DataFrame) -> DataFrame:
    """Migrations (id, text) that a table of applied ones lacks, in order, with their checksums."""
    rows = applied.sparkSession.createDataFrame(list(known), "id string, body string").withColumn("checksum", F.sha2("body", 256)).drop("body")
    return rows.join(applied, "id", "left_anti").orderBy("id")
