"""Schemas, keys and codings of the transit tables."""

from __future__ import annotations

from pyspark.sql import types as T

STOPS = T.StructType([
    T.StructField("vgnkennung", T.ShortType()), T.StructField("vagkennung", T.ArrayType(T.StringType())), T.StructField("haltestellenname", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("produkt_bus", T.ShortType()), T.StructField("produkt_ubahn", T.ShortType()),
    T.StructField("produkt_tram", T.ShortType()), T.StructField("produkt_sbahn", T.ShortType()), T.StructField("produkt_rbahn", T.ShortType()), T.StructField("updated_at", T.TimestampNTZType()),
])
TRIPS = T.StructType([
    T.StructField("fahrtnummer", T.IntegerType()), T.StructField("betriebstag", T.DateType()), T.StructField("produkt", T.ByteType()), T.StructField("linienname", T.StringType()),
    T.StructField("besetzungsgrad", T.ByteType()), T.StructField("fahrzeugnummer", T.IntegerType()), T.StructField("richtung", T.ByteType()), T.StructField("faelltaus", T.ShortType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])
STOP_EVENTS = T.StructType([
    T.StructField("fahrtnummer", T.IntegerType()), T.StructField("betriebstag", T.DateType()), T.StructField("produkt", T.ByteType()), T.StructField("vgnkennung", T.ShortType()),
    T.StructField("haltepunkt", T.ShortType()), T.StructField("richtungstext", T.StringType()), T.StructField("ankunft_soll", T.TimestampNTZType()), T.StructField("ankunft_v", T.ShortType()),
    T.StructField("abfahrt_soll", T.TimestampNTZType()), T.StructField("abfahrt_v", T.ShortType()), T.StructField("updated_at", T.TimestampNTZType()),
])
OBSERVATIONS = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("device", T.StringType()), T.StructField("sequence", T.ShortType()), T.StructField("block_identifier", T.StringType()),
    T.StructField("rail_temperature", T.ShortType()), T.StructField("ambient_temperature", T.ShortType()), T.StructField("raw_telegram", T.StringType()), T.StructField("ingested_at", T.TimestampNTZType()),
])

STOP_KEY = ("vgnkennung",)
TRIP_KEY = ("betriebstag", "fahrtnummer", "produkt")
STOP_EVENT_KEY = ("betriebstag", "vgnkennung", "fahrtnummer", "produkt")
OBSERVATION_KEY = ("device", "timestamp")

# fixed values: codings of modes and occupancy
PRODUCTS = {"Bus": 1, "UBahn": 2, "Tram": 3, "SBahn": 4, "RBahn": 5}
OCCUPANCY = {"Unbekannt": 1, "Schwachbesetzt": 2, "Starkbesetzt": 3, "Ueberfuellt": 4}
