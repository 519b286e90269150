"""Transit tables derived from the generated star schema, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators.versioned import latest_version
from taktwerk.sources.schema import OCCUPANCY, PRODUCTS, STOP_EVENT_KEY

DAY, FROM, TO, AS_OF = "1995-06-17", "1995-06-01", "1995-06-30", "2001-08-02"
LINE, VEHICLE = "U1", 1007


class Fixtures:
    """Lazily built tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _key_type(self, name: str, key: str) -> str:
        """Type of the stop ``key`` + 1: Int16, as the reference has it, or an int where the table holds keys beyond.
        Row groups whose statistics show that all keys fit are not read."""
        return "smallint" if self.raw(name).where(~F.col(key).between(-(1 << 15) - 1, (1 << 15) - 2)).isEmpty() else "int"

    @cached_property
    def stop_type(self) -> str:
        return self._key_type("part", "p_partkey")

    @cached_property
    def event_stop_type(self) -> str:
        return self._key_type("lineitem", "l_partkey")

    @property
    def stops(self) -> DataFrame:
        return self.raw("part").select(
            (F.col("p_partkey") + 1).cast(self.stop_type).alias("vgnkennung"), F.split("p_type", " ").alias("vagkennung"), F.col("p_name").alias("haltestellenname"),
            F.expr("49.3e0 + ((p_partkey * 37) % 1000) * 3e-4").alias("latitude"), F.expr("10.9e0 + ((p_partkey * 91) % 1000) * 4e-4").alias("longitude"),
            (F.col("p_size") % 2).cast("smallint").alias("produkt_bus"), (F.col("p_size") % 3 == 0).cast("smallint").alias("produkt_ubahn"),
            (F.col("p_size") % 5 == 0).cast("smallint").alias("produkt_tram"), F.lit(0).cast("smallint").alias("produkt_sbahn"), F.lit(0).cast("smallint").alias("produkt_rbahn"),
        )

    @property
    def trips(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").cast("int").alias("fahrtnummer"), F.col("o_orderdate").cast("date").alias("betriebstag"), (F.col("o_custkey") % 3 + 1).cast("tinyint").alias("produkt"),
            F.expr("case o_custkey % 3 when 1 then concat('U', o_orderkey % 3 + 1) when 2 then cast(o_orderkey % 5 + 4 as string) else cast(o_orderkey % 40 + 20 as string) end").alias("linienname"),
            F.substring("o_orderpriority", 1, 1).cast("tinyint").alias("besetzungsgrad"),
            F.expr("cast(case when o_orderkey % 17 = 0 then -1 when o_orderkey % 19 = 0 then 0 else 1000 + o_custkey % 50 end as int)").alias("fahrzeugnummer"),
            (F.col("o_orderkey") % 2 + 1).cast("tinyint").alias("richtung"), F.expr("cast(if(o_orderstatus = 'P' and o_orderkey % 10 = 0, 1, 0) as smallint)").alias("faelltaus"),
        )

    @property
    def raw_stop_events(self) -> DataFrame:
        """All versions of stop events, as they were appended."""
        orders = self.raw("orders").select("o_orderkey", "o_orderdate", "o_custkey")
        minutes = "cast((o_orderkey * 7) % 1320 + l_linenumber * 3 as int)"
        return self.raw("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderkey").cast("int").alias("fahrtnummer"), F.col("o_orderdate").cast("date").alias("betriebstag"), (F.col("o_custkey") % 3 + 1).cast("tinyint").alias("produkt"),
            (F.col("l_partkey") + 1).cast(self.event_stop_type).alias("vgnkennung"), (F.col("l_suppkey") % 4).cast("smallint").alias("haltepunkt"),
            F.expr(f"if(l_linenumber = 1, null, timestampadd(MINUTE, {minutes}, o_orderdate))").alias("ankunft_soll"),
            F.expr("if(l_linenumber = 1, null, cast(l_quantity * 24 - 300 as smallint))").alias("ankunft_v"),
            F.expr(f"timestampadd(SECOND, 30, timestampadd(MINUTE, {minutes}, o_orderdate))").alias("abfahrt_soll"),
            F.expr("if(l_linenumber = 7, null, cast(l_quantity * 30 - 330 as smallint))").alias("abfahrt_v"),
            F.col("l_shipdate").alias("updated_at"), "l_linenumber", "l_suppkey", "l_extendedprice",
        )

    @property
    def stop_events(self) -> DataFrame:
        """One row for each key, the latest."""
        return latest_version(self.raw_stop_events, STOP_EVENT_KEY, "updated_at", "l_linenumber", "l_suppkey", "l_extendedprice").drop("updated_at", "l_linenumber", "l_suppkey", "l_extendedprice")

    def trip_answers(self, start: str, end: str) -> DataFrame:
        """(poll, answer): each trip of the days as the upstream tells of it, at midnight as planned and at noon with its
        actual times; a last poll three days later moves the clock on."""
        iso = lambda c, plus=None: F.date_format(F.col(c) if plus is None else F.timestamp_add("SECOND", plus, F.col(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        noon = F.col("hour") == 12
        actual = lambda kind: F.when(noon, iso(f"{kind}_soll", F.col(f"{kind}_v").cast("int")))
        stop = F.struct(
            F.col("vgnkennung").alias("VGNKennung"), F.concat(F.lit("VGN:"), "haltepunkt").alias("Haltepunkt"), iso("ankunft_soll").alias("AnkunftszeitSoll"), actual("ankunft").alias("AnkunftszeitIst"),
            iso("abfahrt_soll").alias("AbfahrtszeitSoll"), actual("abfahrt").alias("AbfahrtszeitIst"),
        )
        key = ["fahrtnummer", "betriebstag", "produkt", "linienname", "richtung"]
        days = F.col("betriebstag").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        rows = self.stop_events.where(days).join(self.trips.where(days).select(*key), ["fahrtnummer", "betriebstag", "produkt"]).withColumn("hour", F.explode(F.array(F.lit(0), F.lit(12))))
        placed = F.struct(F.coalesce("ankunft_soll", "abfahrt_soll").alias("t"), "vgnkennung", stop.alias("s"))
        trips = rows.groupBy(*key, "hour").agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["s"]).alias("stops"))  # the stops of one trip
        name = F.create_map(*[F.lit(x) for name, code in PRODUCTS.items() for x in (code, name)])
        trip = F.struct(
            F.col("fahrtnummer").alias("Fahrtnummer"), F.col("betriebstag").cast("string").alias("Betriebstag"), name[F.col("produkt").cast("int")].alias("Produkt"), F.col("linienname").alias("Linienname"),
            F.concat(F.lit("Richtung"), "richtung").alias("Richtung"), F.col("stops").alias("Fahrtverlauf"),
        )
        poll = F.unix_millis(F.col("betriebstag").cast("timestamp")) + F.col("hour") * 3_600_000
        out = trips.select(poll.alias("poll"), F.to_json(F.struct(trip.alias("Fahrt"), F.struct(F.lit(0).alias("RequestTime")).alias("Meta"))).alias("answer"))
        last = f"unix_millis(timestampadd(DAY, 3, timestamp '{end}')) AS poll, '{{\"Fahrt\":{{\"Fahrtnummer\":-1,\"Betriebstag\":\"{end}\",\"Produkt\":\"Bus\",\"Fahrtverlauf\":[{{\"VGNKennung\":0}}]}}}}' AS answer"
        return out.unionByName(self.spark.sql(f"SELECT {last}"))

    def trips_answers(self, start: str, end: str) -> DataFrame:
        """(poll, answer): the active trips of each mode, polled at midnight of each of the days."""
        day = F.col("betriebstag")
        when = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        trip = F.struct(
            F.col("fahrtnummer").alias("Fahrtnummer"), day.cast("string").alias("Betriebstag"), F.col("linienname").alias("Linienname"), F.get(F.array(*map(F.lit, ["", *OCCUPANCY, "?"])), F.col("besetzungsgrad").cast("int")).alias("Besetztgrad"),
            F.when(F.col("fahrzeugnummer") == 0, "PVU").when(F.col("fahrzeugnummer") > 0, F.col("fahrzeugnummer").cast("string")).alias("Fahrzeugnummer"), F.concat(F.lit("Richtung"), "richtung").alias("Richtung"),
            (F.col("faelltaus") == 1).alias("FaelltAus"), when.alias("Startzeit"), when.alias("Endzeit"),
        )
        name = F.create_map(*[F.lit(x) for name, code in PRODUCTS.items() for x in (code, name)])
        rows = self.trips.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("betriebstag", "produkt", trip.alias("trip"))
        modes = rows.groupBy("betriebstag", "produkt").agg(F.collect_list("trip").alias("trips"))  # an answer holds the trips of a mode on a day
        answer = F.struct(F.struct(name[F.col("produkt").cast("int")].alias("Produkt"), F.col("trips").alias("Fahrten")).alias("Fahrt"), F.struct(F.lit(0).alias("RequestTime")).alias("Meta"))
        return modes.select(F.unix_millis(day.cast("timestamp")).alias("poll"), F.to_json(answer).alias("answer"))

    def stops_answers(self, poll: int) -> DataFrame:
        """(poll, answer): the stop list, in 16 answers."""
        flags = F.concat_ws(",", *[F.when(F.col(f"produkt_{p.lower()}") > 0, F.lit(p)) for p in PRODUCTS])
        stop = F.struct(F.col("vgnkennung").alias("VGNKennung"), F.array_join("vagkennung", ",").alias("VAGKennung"), F.col("haltestellenname").alias("Haltestellenname"), F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), flags.alias("Produkte"))
        lists = self.stops.groupBy(F.pmod("vgnkennung", F.lit(16)).alias("share")).agg(F.collect_list(stop).alias("Haltestellen"))
        return lists.select(F.lit(poll).cast("bigint").alias("poll"), F.to_json(F.struct("Haltestellen")).alias("answer"))

    @property
    def events(self) -> DataFrame:
        return self.raw("events")


def waited() -> tuple[Column, Column]:
    """(wait, request) in milliseconds of the job of a stop event: one in forty waits long, one in fifty answers takes long."""
    h = "(cast(fahrtnummer as bigint) * 31 + cast(vgnkennung as bigint) * 17)"
    return F.expr(f"cast(if({h} % 40 = 0, 200000, {h} % 36000) as bigint)"), F.expr(f"cast({h} * 7 % 1200 + if({h} % 50 = 0, 40000, 0) as bigint)")


#: The same tables for DuckDB.
PRELUDE = """
WITH haltestellen AS (SELECT (p_partkey + 1)::SMALLINT AS vgnkennung, string_split(p_type, ' ') AS vagkennung, p_name AS haltestellenname,
    49.3e0 + ((p_partkey * 37) % 1000) * 3e-4 AS latitude, 10.9e0 + ((p_partkey * 91) % 1000) * 4e-4 AS longitude,
    (p_size % 2)::SMALLINT AS produkt_bus, (p_size % 3 = 0)::SMALLINT AS produkt_ubahn, (p_size % 5 = 0)::SMALLINT AS produkt_tram,
    0::SMALLINT AS produkt_sbahn, 0::SMALLINT AS produkt_rbahn FROM part),
fahrten AS (SELECT o_orderkey::INTEGER AS fahrtnummer, o_orderdate::DATE AS betriebstag, (o_custkey % 3 + 1)::TINYINT AS produkt,
    CASE o_custkey % 3 WHEN 1 THEN 'U' || (o_orderkey % 3 + 1) WHEN 2 THEN (o_orderkey % 5 + 4)::VARCHAR ELSE (o_orderkey % 40 + 20)::VARCHAR END AS linienname,
    o_orderpriority[1]::TINYINT AS besetzungsgrad,
    (CASE WHEN o_orderkey % 17 = 0 THEN -1 WHEN o_orderkey % 19 = 0 THEN 0 ELSE 1000 + o_custkey % 50 END)::INTEGER AS fahrzeugnummer,
    (o_orderkey % 2 + 1)::TINYINT AS richtung, (CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 1 ELSE 0 END)::SMALLINT AS faelltaus FROM orders),
fh_raw AS (SELECT o_orderkey::INTEGER AS fahrtnummer, o_orderdate::DATE AS betriebstag, (o_custkey % 3 + 1)::TINYINT AS produkt, (l_partkey + 1)::SMALLINT AS vgnkennung,
    (l_suppkey % 4)::SMALLINT AS haltepunkt,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE o_orderdate + to_minutes(((o_orderkey * 7) % 1320 + l_linenumber * 3)::INTEGER) END AS ankunft_soll,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE (l_quantity * 24 - 300)::SMALLINT END AS ankunft_v,
    o_orderdate + to_minutes(((o_orderkey * 7) % 1320 + l_linenumber * 3)::INTEGER) + to_seconds(30) AS abfahrt_soll,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_quantity * 30 - 330)::SMALLINT END AS abfahrt_v,
    l_shipdate AS updated_at, l_linenumber, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fahrten_halte AS (SELECT * EXCLUDE (updated_at, l_linenumber, l_suppkey, l_extendedprice) FROM fh_raw
    QUALIFY row_number() OVER (PARTITION BY betriebstag, vgnkennung, fahrtnummer, produkt ORDER BY updated_at DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
"""
