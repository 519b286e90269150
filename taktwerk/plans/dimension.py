"""The stop table in step with the stop list, and stop events of unknown stops.

The stored table is the export without every seventh stop, with old names for every fifth, and with some stops that
the list no longer has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from taktwerk.operators import dimension as op
from taktwerk.plans.delays import in_days
from taktwerk.plans.registry import query
from taktwerk.plans.upstream import EXPORTED, kept
from taktwerk.sources import feeds, upstream
from taktwerk.sources.fixtures import FROM, TO, Fixtures

VALUES = ["haltestellenname", "latitude", "longitude", "produkt_bus", "produkt_ubahn", "produkt_tram"]
_STORED = ", st AS (SELECT CASE WHEN vgnkennung % 13 = 0 THEN -vgnkennung ELSE vgnkennung END AS vgnkennung, CASE WHEN vgnkennung % 5 = 0 THEN upper(haltestellenname) ELSE haltestellenname END AS haltestellenname, latitude, longitude, produkt_bus, produkt_ubahn, produkt_tram FROM haltestellen WHERE vgnkennung % 7 <> 0)"


def stored(t: Fixtures):
    name = F.when(F.col("vgnkennung") % 5 == 0, F.upper("haltestellenname")).otherwise(F.col("haltestellenname"))
    number = F.when(F.col("vgnkennung") % 13 == 0, -F.col("vgnkennung")).otherwise(F.col("vgnkennung"))
    return t.stops.where("vgnkennung % 7 <> 0").withColumn("haltestellenname", name).withColumn("vgnkennung", number).select("vgnkennung", *VALUES)


def incoming(t: Fixtures):
    return feeds.listed_stops(upstream.reader(t.spark, kept(t, "stops", t.stops_answers(EXPORTED)), "stops"), t.stop_type).select("vgnkennung", *VALUES)


@query("stop_sync", _STORED + " SELECT coalesce(h.vgnkennung, st.vgnkennung)::SMALLINT AS vgnkennung, coalesce(h.haltestellenname, st.haltestellenname) AS haltestellenname, CASE WHEN st.vgnkennung IS NULL THEN 'added' WHEN h.vgnkennung IS NULL THEN 'gone' WHEN h.haltestellenname = st.haltestellenname THEN 'same' ELSE 'changed' END AS change FROM haltestellen h FULL JOIN st ON h.vgnkennung = st.vgnkennung")
def stop_sync(t: Fixtures):
    """What a new stop list changes in the stored table."""
    return op.changes(stored(t), incoming(t), "vgnkennung", VALUES).select("vgnkennung", "haltestellenname", "change")


@query("stop_sync_counts", _STORED + " SELECT change, count(*) AS n FROM (SELECT CASE WHEN st.vgnkennung IS NULL THEN 'added' WHEN h.vgnkennung IS NULL THEN 'gone' WHEN h.haltestellenname = st.haltestellenname THEN 'same' ELSE 'changed' END AS change FROM haltestellen h FULL JOIN st ON h.vgnkennung = st.vgnkennung) GROUP BY 1")
def stop_sync_counts(t: Fixtures):
    return stop_sync(t).groupBy("change").agg(F.count("*").alias("n"))


@query("held_stop_events", _STORED + f" SELECT betriebstag, fahrtnummer, produkt, f.vgnkennung, CASE WHEN st.vgnkennung IS NULL THEN 'released' ELSE 'known' END AS state FROM fahrten_halte f LEFT JOIN st USING (vgnkennung) WHERE betriebstag BETWEEN DATE '{FROM}' AND DATE '{TO}'")
def held_stop_events(t: Fixtures):
    """Stop events at stops that the table lacks: held back, the stop learned from them, then released; none is lost."""
    facts = t.stop_events.where(in_days())
    _, held = op.held_back(facts, stored(t), "vgnkennung")
    learned = op.repairs(held, "vgnkennung", {"haltepunkt": "haltepunkt"}, "abfahrt_soll")
    return op.released(facts, stored(t), learned, "vgnkennung").select("betriebstag", "fahrtnummer", "produkt", "vgnkennung", "state")


@query("repaired_stops", _STORED + f" SELECT vgnkennung, arg_max(haltepunkt, (abfahrt_soll, haltepunkt)) AS haltepunkt FROM fahrten_halte WHERE betriebstag BETWEEN DATE '{FROM}' AND DATE '{TO}' AND vgnkennung NOT IN (SELECT vgnkennung FROM st) GROUP BY 1")
def repaired_stops(t: Fixtures):
    """The rows that the stop table gets for stops it lacked, from the latest event of each."""
    _, held = op.held_back(t.stop_events.where(in_days()), stored(t), "vgnkennung")
    return op.repairs(held, "vgnkennung", {"haltepunkt": "haltepunkt"}, "abfahrt_soll")
