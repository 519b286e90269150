"""Upstream answers (JSON) brought to rows of the transit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions.text import direction, occupancy_code, platform, product_code, product_flags, vehicle_number
from taktwerk.functions.timing import delay_seconds, normal_time

_STOP = "struct<VGNKennung:int,VAGKennung:string,Haltestellenname:string,Haltepunkt:string,Richtungstext:string,Latitude:double,Longitude:double,AnkunftszeitSoll:string,AnkunftszeitIst:string,AbfahrtszeitSoll:string,AbfahrtszeitIst:string>"
TRIP = f"Fahrtnummer int, Betriebstag date, Produkt string, Linienname string, Fahrzeugnummer string, Besetzgrad string, Richtung string, Richtungstext string, FaelltAus boolean, Fahrtverlauf array<{_STOP}>"


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIP).json(path)


def trips(feed: DataFrame) -> DataFrame:
    """A row for each trip, its texts coded, with the times of its first and last stop."""
    first, last = F.try_element_at("Fahrtverlauf", F.lit(1)), F.try_element_at("Fahrtverlauf", F.lit(-1))
    start = F.coalesce(*[normal_time(first[c]) for c in ("AbfahrtszeitSoll", "AbfahrtszeitIst", "AnkunftszeitSoll", "AnkunftszeitIst")])
    end = F.coalesce(*[normal_time(last[c]) for c in ("AnkunftszeitSoll", "AnkunftszeitIst", "AbfahrtszeitSoll", "AbfahrtszeitIst")])
    return feed.select(
        F.col("Fahrtnummer").alias("fahrtnummer"), F.col("Betriebstag").alias("betriebstag"), product_code(F.col("Produkt")).cast("tinyint").alias("produkt"), F.col("Linienname").alias("linienname"),
        occupancy_code(F.col("Besetzgrad")).cast("tinyint").alias("besetzungsgrad"), vehicle_number(F.col("Fahrzeugnummer")).alias("fahrzeugnummer"), direction(F.col("Richtung")).cast("tinyint").alias("richtung"),
        F.coalesce(F.col("FaelltAus"), F.lit(False)).cast("smallint").alias("faelltaus"), start.alias("starts"), end.alias("ends"),
    )


def stop_events(feed: DataFrame, stop: str = "smallint") -> DataFrame:
    """A row for each stop of each trip with delays in seconds; times too far apart for 16 bits have none. The poll stays, where there is one.

    ``stop`` is the type of the stop's number.
    """
    poll = ["poll"] if "poll" in feed.columns else []
    rows = feed.select(*poll, "Fahrtnummer", "Betriebstag", "Produkt", F.col("Richtungstext").alias("to"), F.posexplode("Fahrtverlauf").alias("idx", "s"))
    time = {c: normal_time(F.col(f"s.{c}")) for c in ("AnkunftszeitSoll", "AnkunftszeitIst", "AbfahrtszeitSoll", "AbfahrtszeitIst")}
    second = lambda ms: F.date_trunc("second", F.timestamp_millis(ms)).cast("timestamp_ntz")
    delay = lambda kind: F.when(time[f"{kind}Soll"].isNotNull(), delay_seconds(time[f"{kind}Soll"], time[f"{kind}Ist"])).try_cast("smallint")
    return rows.select(
        *poll, F.col("Fahrtnummer").alias("fahrtnummer"), F.col("Betriebstag").alias("betriebstag"), product_code(F.col("Produkt")).cast("tinyint").alias("produkt"), F.col("s.VGNKennung").cast(stop).alias("vgnkennung"),
        platform(F.col("s.Haltepunkt")).cast("smallint").alias("haltepunkt"), F.coalesce("s.Richtungstext", "to").alias("richtungstext"), "idx",
        second(time["AnkunftszeitSoll"]).alias("ankunft_soll"), delay("Ankunftszeit").alias("ankunft_v"), second(time["AbfahrtszeitSoll"]).alias("abfahrt_soll"), delay("Abfahrtszeit").alias("abfahrt_v"),
    )


def itineraries(feed: DataFrame) -> DataFrame:
    """A row for each answer: the trip's key, line, direction, when it was polled, and its stops with times in milliseconds."""
    stop = lambda s: F.struct(s["VGNKennung"].alias("vgnkennung"), *[normal_time(s[c]).alias(n) for n, c in (("an_soll", "AnkunftszeitSoll"), ("an_ist", "AnkunftszeitIst"), ("ab_soll", "AbfahrtszeitSoll"), ("ab_ist", "AbfahrtszeitIst"))])
    return feed.select(
        F.col("Betriebstag").alias("betriebstag"), F.col("Fahrtnummer").alias("fahrtnummer"), product_code(F.col("Produkt")).cast("tinyint").alias("produkt"),
        F.col("Linienname").alias("linienname"), direction(F.col("Richtung")).cast("tinyint").alias("richtung"), "poll", F.transform("Fahrtverlauf", stop).alias("stops"),
    )


def active_trips(feed: DataFrame) -> DataFrame:
    """Rows of the trip table from polls of the active trips, with the times between which a trip runs."""
    return feed.select(
        F.col("Fahrtnummer").alias("fahrtnummer"), F.col("Betriebstag").alias("betriebstag"), product_code(F.col("Produkt")).cast("tinyint").alias("produkt"), F.col("Linienname").alias("linienname"),
        occupancy_code(F.coalesce("Besetzgrad", F.lit("Unbekannt"))).cast("tinyint").alias("besetzungsgrad"), vehicle_number(F.col("Fahrzeugnummer")).alias("fahrzeugnummer"), direction(F.col("Richtung")).cast("tinyint").alias("richtung"),
        F.coalesce(F.col("FaelltAus"), F.lit(False)).cast("smallint").alias("faelltaus"), normal_time(F.col("Startzeit")).alias("starts"), normal_time(F.col("Endzeit")).alias("ends"), "poll",
    )


def listed_stops(feed: DataFrame, stop: str = "smallint") -> DataFrame:
    """Rows of the stop table from polls of the stop list; modes and other codes are lists by comma. ``stop`` is the type of the stop's number."""
    return feed.select(
        F.col("VGNKennung").cast(stop).alias("vgnkennung"), F.transform(F.split("VAGKennung", ","), lambda x: F.trim(x)).alias("vagkennung"), F.col("Haltestellenname").alias("haltestellenname"), F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"),
        *[c.alias(n) for n, c in product_flags(F.col("Produkte")).items()], "poll",
    )
