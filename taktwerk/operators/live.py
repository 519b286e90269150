"""The live map: trips with the stops around them, where they are, and which ones a viewer asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.functions.geo import in_box


def with_stops(trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds names and places of the current and the next stop; trips keep their row where a stop is unknown."""
    here = stops.select("vgnkennung", "haltestellenname", "latitude", "longitude")
    there = stops.select(F.col("vgnkennung").alias("next_vgnkennung"), F.col("haltestellenname").alias("next_haltestellenname"), F.col("latitude").alias("next_latitude"), F.col("longitude").alias("next_longitude"))
    return trips.join(here, "vgnkennung", "left").join(there, "next_vgnkennung", "left")


def displayed(trips: DataFrame) -> DataFrame:
    """The estimated place, else that of the current stop."""
    return trips.withColumns({"show_latitude": F.coalesce("est_latitude", "latitude"), "show_longitude": F.coalesce("est_longitude", "longitude")})


def asked(trips: DataFrame, lines: str | None = None, box: tuple[tuple[float, float], tuple[float, float]] | None = None) -> DataFrame:
    """Without placeholders (stop 0); of the lines of a comma-separated list and within a box, where given."""
    trips = trips.where("vgnkennung <> 0")
    if lines:
        trips = trips.where(F.col("linienname").isin(*lines.split(",")))
    return trips.where(in_box(F.col("show_latitude"), F.col("show_longitude"), *box)) if box else trips


def by_next_stop(trips: DataFrame, line: str, direction: int, next_stop: int, now: Column) -> DataFrame:
    return trips.where((F.col("linienname") == line) & (F.col("richtung") == direction) & (F.col("next_vgnkennung") == next_stop) & (F.col("expires_at") >= now))


def keys_with_prefix(keys: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Counts of keys by the prefix they start with."""
    kind = F.coalesce(*[F.when(F.col("key").startswith(p), F.lit(p)) for p in prefixes])
    return keys.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))
