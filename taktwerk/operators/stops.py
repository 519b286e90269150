"""Stop search, neighbourhoods and the order of stops along lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.geo import haversine
from taktwerk.functions.text import matches_pattern, product_list
from taktwerk.sources.schema import PRODUCTS, TRIP_KEY


def search(stops: DataFrame, query: Mapping[str, str]) -> DataFrame:
    """Stops of which every given attribute matches its pattern; all stops without one."""
    for attribute, pattern in query.items():
        stops = stops.where(matches_pattern(F.col(attribute), pattern))
    return stops


def in_radius(stops: DataFrame, latitude: float, longitude: float, radius: float = 500) -> DataFrame:
    """Stops within so many metres, with their distance. A box of latitudes goes first, which the scan can use."""
    metres_a_degree = 111_000.0
    near = stops.where(F.col("latitude").between(latitude - radius / metres_a_degree, latitude + radius / metres_a_degree))
    return near.withColumn("distanz", haversine(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude"))).where(F.col("distanz") <= radius)


def nearest(stops: DataFrame, latitude: float, longitude: float, radius: float = 500, n: int = 5) -> DataFrame:
    return in_radius(stops, latitude, longitude, radius).orderBy("distanz", "vgnkennung").limit(n)


def listed(stops: DataFrame) -> DataFrame:
    """Stops with their codes and modes as comma-separated lists."""
    flags = {f"produkt_{p.lower()}": F.col(f"produkt_{p.lower()}") for p in PRODUCTS}
    return stops.select("vgnkennung", "haltestellenname", "latitude", "longitude", F.array_join("vagkennung", ",").alias("vagkennung"), product_list(flags).alias("produkte"))


def line_order(events: DataFrame, trips: DataFrame) -> DataFrame:
    """(linienname, richtung, vgnkennung, pos): stops of a line by the earliest time of day they are served."""
    served = F.coalesce("ankunft_soll", "abfahrt_soll")
    time = F.hour(served) * 3600 + F.minute(served) * 60 + F.second(served)  # a number: its least needs no sorting
    first = events.join(trips.select(*TRIP_KEY, "linienname", "richtung"), list(TRIP_KEY)).groupBy("linienname", "richtung", "vgnkennung").agg(F.min(time).alias("first_time"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("linienname", "richtung").orderBy("first_time", "vgnkennung"))).drop("first_time")
