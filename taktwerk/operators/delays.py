"""Aggregations of delays over stop events, trips and stops. All joins are inner equi-joins on keys; which side is
broadcast is left to the size-checked choice of the optimizer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.functions.timing import shifted_hour, years_back
from taktwerk.sources.schema import TRIP_KEY


def events_with_trips(events: DataFrame, trips: DataFrame) -> DataFrame:
    return events.join(trips, list(TRIP_KEY))


def mean_delay_by_stop(events: DataFrame, stops: DataFrame, days: Column) -> DataFrame:
    """Mean departure delay of each stop and day. Events are averaged before the join, so the stops meet few rows."""
    means = events.where(days & F.col("abfahrt_v").isNotNull()).groupBy("vgnkennung", "betriebstag").agg(F.avg("abfahrt_v").alias("avg_delay"))
    return means.join(stops.select("vgnkennung", "latitude", "longitude"), "vgnkennung").select("avg_delay", "vgnkennung", "latitude", "longitude", "betriebstag")


def mean_delay_by(events: DataFrame, trips: DataFrame, column: str, days: Column) -> DataFrame:
    """Mean departure delay by an attribute of the trip."""
    own = trips.select(*TRIP_KEY, column)
    return events_with_trips(events.where(days & F.col("abfahrt_v").isNotNull()), own).groupBy(column, "betriebstag").agg(F.avg("abfahrt_v").alias("avg_delay")).select(column, "avg_delay", "betriebstag")


def ranked(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy(F.col("avg_delay").desc_nulls_last(), *ties)


def histogram(events: DataFrame, trips: DataFrame, start: str, end: str, bin_size: int = 60, line: str | None = None, product: int | None = None, vehicle: int | None = None, min_delay: int | None = None, max_delay: int | None = None) -> DataFrame:
    """Arrival delays by bin. Optional conditions join the plan only where they are given; without one on trips the join stays,
    as only events of known trips count."""
    delay = F.col("ankunft_v")
    on_events = [F.col("betriebstag").between(F.lit(start).cast("date"), F.lit(end).cast("date")), delay.isNotNull()]
    on_events += [delay >= min_delay] if min_delay is not None else []
    on_events += [delay <= max_delay] if max_delay is not None else []
    on_trips = [F.col(c) == v for c, v in (("linienname", line), ("produkt", product), ("fahrzeugnummer", vehicle or None)) if v is not None]
    for condition in on_events:
        events = events.where(condition)
    for condition in on_trips:
        trips = trips.where(condition)
    bins = (F.floor(delay / bin_size) * bin_size).cast("double").alias("bin_start")
    return events_with_trips(events, trips.select(*TRIP_KEY)).groupBy(bins).agg(F.count("*").alias("count")).orderBy("bin_start")


def line_profile(events: DataFrame, trips: DataFrame, stops: DataFrame, line: str, since: Column) -> DataFrame:
    """Trips and mean delays by stop, direction and hour of a line."""
    rows = events_with_trips(events.where(F.col("betriebstag") >= since), trips.where(F.col("linienname") == line).select(*TRIP_KEY, "richtung"))
    rows = rows.groupBy("vgnkennung", "richtung", shifted_hour(F.col("ankunft_soll")).alias("time_bucket")).agg(
        F.count("*").alias("trip_count"), F.coalesce(F.avg("ankunft_v"), F.lit(0.0)).alias("avg_arrival_delay"), F.coalesce(F.avg("abfahrt_v"), F.lit(0.0)).alias("avg_departure_delay")
    )
    named = rows.join(stops.select("vgnkennung", "haltestellenname", "latitude", "longitude"), "vgnkennung")
    return named.select("vgnkennung", "haltestellenname", "latitude", "longitude", "richtung", "time_bucket", "trip_count", "avg_arrival_delay", "avg_departure_delay").orderBy("vgnkennung", "richtung", "time_bucket")


def punctuality(events: DataFrame, trips: DataFrame, as_of: Column, periods: Sequence[Column], years: int = 1, outer_neg: int = -900, outer_pos: int = 900, lower_inner: int = -60, upper_inner: int = 180) -> DataFrame:
    """Shares of early, timely and late departures by period and product. Bounds belong to both classes they divide."""
    v = F.col("abfahrt_v")
    share = lambda lo, hi: F.count_if(v.between(lo, hi)) * F.lit(100.0) / F.count("*")
    rows = events.where(v.isNotNull() & (F.col("betriebstag") >= years_back(as_of, years)))
    return events_with_trips(rows, trips.select(*TRIP_KEY)).groupBy(*periods, "produkt").agg(
        F.count("*").alias("total_departures"), share(outer_neg, lower_inner).alias("percentage_early"), share(lower_inner, upper_inner).alias("percentage_on_time"), share(upper_inner, outer_pos).alias("percentage_late")
    )
