"""Departures of stops, the trips found in them, and the requests that ask for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktwerk.functions.text import member_size, member_value, positive_or
from taktwerk.operators import departures as op
from taktwerk.operators.observations import accepted, rejected
from taktwerk.plans.params import Departures
from taktwerk.plans.registry import query
from taktwerk.sources.fixtures import DAY, Fixtures

ASKED = Departures(time_span=1440, limit_count=3)
_BOARD = (
    f", bd AS (SELECT vgnkennung, fahrtnummer, betriebstag, produkt, linienname, epoch_ms(abfahrt_soll) AS departs, row_number() OVER (PARTITION BY vgnkennung ORDER BY abfahrt_soll, fahrtnummer, produkt) AS pos"
    f" FROM fahrten_halte JOIN fahrten USING (fahrtnummer, betriebstag, produkt) WHERE abfahrt_soll BETWEEN TIMESTAMP '{DAY}' AND TIMESTAMP '{DAY}' + INTERVAL {ASKED.time_span} MINUTE QUALIFY pos <= {ASKED.limit_count})"
)


def board(t: Fixtures):
    return op.board(t.stop_events, t.trips, F.lit(DAY).cast("timestamp_ntz"), ASKED)


@query("departures_of_stops", _BOARD + " SELECT vgnkennung, fahrtnummer, produkt, linienname, departs, pos::INTEGER AS pos FROM bd")
def departures_of_stops(t: Fixtures):
    return board(t).drop("betriebstag")


@query("departures_of_line", f"SELECT vgnkennung, fahrtnummer, epoch_ms(abfahrt_soll) AS departs FROM fahrten_halte JOIN fahrten USING (fahrtnummer, betriebstag, produkt) WHERE linienname = 'U1' AND produkt = 2 AND abfahrt_soll BETWEEN TIMESTAMP '{DAY} 06:00:00' AND TIMESTAMP '{DAY} 06:00:00' + INTERVAL 720 MINUTE QUALIFY row_number() OVER (PARTITION BY vgnkennung ORDER BY abfahrt_soll, fahrtnummer, produkt) <= 30")
def departures_of_line(t: Fixtures):
    asked = Departures.of({"Line": "U1", "Product": 2, "TimeSpan": 720, "TimeDelay": 360})
    return op.board(t.stop_events, t.trips, F.lit(DAY).cast("timestamp_ntz"), asked).select("vgnkennung", "fahrtnummer", "departs")


@query("departure_of_trip", _BOARD + f", jb AS (SELECT DISTINCT vgnkennung, fahrtnummer FROM fahrten_halte WHERE betriebstag = DATE '{DAY}'), ft AS (SELECT vgnkennung, fahrtnummer, min_by(departs, pos) AS departs FROM bd GROUP BY 1, 2) SELECT jb.vgnkennung, jb.fahrtnummer, departs FROM jb LEFT JOIN ft USING (vgnkennung, fahrtnummer)")
def departure_of_trip(t: Fixtures):
    """Late jobs, a stop and a trip each, beside the trip's departure where the stop lists it."""
    jobs = t.stop_events.where(F.col("betriebstag") == F.lit(DAY).cast("date")).select("vgnkennung", "fahrtnummer").distinct()
    return op.matched(jobs, board(t))


@query("discovered_departures", _BOARD + f" SELECT vgnkennung, fahrtnummer, max_by(produkt, pos) AS produkt, max_by(departs, pos) AS departs FROM bd WHERE produkt IN (1, 2) AND fahrtnummer NOT IN (SELECT fahrtnummer FROM fahrten WHERE fahrtnummer % 3 = 0 AND betriebstag = DATE '{DAY}') GROUP BY 1, 2")
def discovered_departures(t: Fixtures):
    """Departures of trips that are not tracked yet; those of every third trip are."""
    known = t.trips.where((F.col("betriebstag") == F.lit(DAY).cast("date")) & (F.col("fahrtnummer") % 3 == 0))
    return op.discovered(board(t), known, [1, 2])


_REQUEST = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey * 2 END AS vgn, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE string_split(p_type, ' ')[1] END AS vag FROM part"


@query("departure_targets", f", rq AS ({_REQUEST}) SELECT id, coalesce(h.vgnkennung::VARCHAR, rq.vgn::VARCHAR, nullif(vag, '')) AS target FROM rq LEFT JOIN haltestellen h ON h.vgnkennung = rq.vgn")
def departure_targets(t: Fixtures):
    """Requests by number or code: the known stop, else the number as given, else the code."""
    part = t.raw("part")
    asked = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") * 2).alias("vgn"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.split("p_type", " ")[0]).alias("vag"))
    known = t.stops.select(F.col("vgnkennung").alias("station"))
    return asked.join(known, asked["vgn"] == known["station"], "left").select("id", op.preferred_target(F.col("station"), F.col("vgn"), F.col("vag")).alias("target"))


@query("configured_numbers", "SELECT event_id, CASE WHEN value > 50 THEN value WHEN value <= 50 AND event_id % 2 = 0 THEN 7e0 WHEN event_id % 5 = 0 THEN 7e0 ELSE greatest(value, 1e-3) END AS number FROM events", prelude=False)
def configured_numbers(t: Fixtures):
    """Settings as text: a positive finite number counts, anything else is the fallback."""
    text = F.when(F.col("value") > 50, F.col("value").cast("string")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("-"), F.col("value").cast("string"))).when(F.col("event_id") % 5 == 0, F.lit("many"))
    text = F.coalesce(text, F.greatest("value", F.lit(1e-3)).cast("string"))
    return t.events.select("event_id", positive_or(text, 7.0).alias("number"))


@query("trace_members", "SELECT event_id, (100 + event_id % 900)::BIGINT AS size, event_type AS route, user_id FROM events", prelude=False)
def trace_members(t: Fixtures):
    """Members of a trace index, a size and the trace as JSON, taken apart again."""
    member = F.concat(((F.col("event_id") % 900) + 100).cast("string"), F.lit(":"), F.to_json(F.struct(F.col("event_type").alias("route"), "user_id")))
    rows = t.events.select("event_id", member.alias("member"))
    trace = member_value(F.col("member"), "route string, user_id bigint")
    return rows.select("event_id", member_size(F.col("member")).alias("size"), trace["route"].alias("route"), trace["user_id"].alias("user_id"))


_OBSERVED = "SELECT event_id, 'device ' || user_id AS device, event_id % 300 - 20 AS rail, event_id % 270 AS ambient, event_id % 256 AS sequence FROM events"
_WITHIN = "rail BETWEEN 0 AND 255 AND ambient BETWEEN 0 AND 255"


def _observed(t: Fixtures):
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit(" device "), F.col("user_id").cast("string")).alias("device"), (F.col("event_id") % 256).alias("sequence"), F.lit("b1").alias("block_identifier"), (F.col("event_id") % 300 - 20).alias("rail_temperature"), (F.col("event_id") % 270).alias("ambient_temperature"), F.lit("00ff").alias("raw_telegram"))


@query("observations_accepted", f"SELECT event_id, device, rail::INTEGER AS rail_temperature, ambient::INTEGER AS ambient_temperature FROM ({_OBSERVED}) WHERE {_WITHIN}", prelude=False)
def observations_accepted(t: Fixtures):
    return accepted(_observed(t)).select("event_id", "device", F.col("rail_temperature").cast("int").alias("rail_temperature"), F.col("ambient_temperature").cast("int").alias("ambient_temperature"))


@query("observations_rejected", f"SELECT CASE WHEN rail NOT BETWEEN 0 AND 255 THEN 'rail_temperature' ELSE 'ambient_temperature' END AS reason, count(*) AS n FROM ({_OBSERVED}) WHERE NOT ({_WITHIN}) GROUP BY 1", prelude=False)
def observations_rejected(t: Fixtures):
    return rejected(_observed(t)).groupBy("reason").agg(F.count("*").alias("n"))
