"""A vehicle's day: where it was, how far it went, what it served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.geo import leg_metres
from taktwerk.sources.schema import TRIP_KEY

#: Numbers that stand for another operator's or for no vehicle.
NO_VEHICLE = (0, -1)


def positions(events: DataFrame, trips: DataFrame, stops: DataFrame, days: Column, vehicles: Column) -> DataFrame:
    """Stop events of vehicles with their places, day and vehicle filtered before the joins."""
    own = trips.where(days & vehicles).select(*TRIP_KEY, "fahrzeugnummer", "linienname", "besetzungsgrad")
    rows = events.where(days).join(own, list(TRIP_KEY)).join(stops.select("vgnkennung", "haltestellenname", "latitude", "longitude"), "vgnkennung")
    return rows.withColumn("zeitpunkt", F.coalesce("abfahrt_soll", "ankunft_soll"))


def _route() -> Window:
    return Window.partitionBy("betriebstag", "fahrzeugnummer").orderBy(F.col("zeitpunkt").asc_nulls_last(), "fahrtnummer", "vgnkennung")


def legs(rows: DataFrame) -> DataFrame:
    """Adds what came before and the metres from there (null for the first); a window for each vehicle and day."""
    w = _route()
    before = {f"vor_{c}": F.lag(c).over(w) for c in ("latitude", "longitude", "linienname", "haltestellenname")}
    rows = rows.withColumns(before | {"pos": F.row_number().over(w)})
    return rows.withColumn("metres", leg_metres(F.col("vor_latitude"), F.col("vor_longitude"), F.col("latitude"), F.col("longitude")))


def running_metres(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("betriebstag", "fahrzeugnummer").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return legs(rows).withColumn("so_far", F.coalesce(F.sum("metres").over(w), F.lit(0)))


def edges(rows: DataFrame) -> DataFrame:
    """How often each way between two named stops was gone so far."""
    way = Window.partitionBy("betriebstag", "fahrzeugnummer", "vor_haltestellenname", "haltestellenname").orderBy("pos")
    return legs(rows).where("pos > 1").withColumn("n", F.row_number().over(way))
