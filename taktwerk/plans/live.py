"""The live map at a moment: trips under way, their places and who asks for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taktwerk.operators import geometry, live
from taktwerk.operators import trips as trip_op
from taktwerk.operators.stops import line_order
from taktwerk.plans.params import Box
from taktwerk.plans.registry import query
from taktwerk.plans.statistics import _ORDER
from taktwerk.plans.stops import _haversine
from taktwerk.plans.trips import _NOW, STATE, now, rows
from taktwerk.sources.fixtures import DAY, Fixtures
from taktwerk.sources.scratch import stored

_ASKED = Box.of((11.2, 49.35), (10.95, 49.5))
BOX = (_ASKED.low, _ASKED.high)

_LIVE = STATE + (
    f", live AS (SELECT betriebstag, fahrtnummer, produkt, vgnkennung, n_vgn AS next_vgnkennung, linienname, richtung, fahrzeugnummer, CASE WHEN st IS NULL OR n_arr IS NULL OR n_arr <= st THEN 0e0 ELSE greatest(0, least(1, ({_NOW} - st) / (n_arr - st)::DOUBLE)) END AS progress,"
    " (SELECT max(arrival) FROM a WHERE a.betriebstag = s.betriebstag AND a.fahrtnummer = s.fahrtnummer AND a.produkt = s.produkt) + 3600000 AS expires_at FROM state s JOIN fahrten USING (betriebstag, fahrtnummer, produkt) WHERE NOT finished)"
)


def trips_under_way(t: Fixtures, moment: Column | None = None):
    state = trip_op.at(rows(t), now() if moment is None else moment).where("not finished")
    own = t.trips.select("betriebstag", "fahrtnummer", "produkt", "linienname", "richtung", "fahrzeugnummer")
    return state.join(own, ["betriebstag", "fahrtnummer", "produkt"]).select(
        "betriebstag", "fahrtnummer", "produkt", "vgnkennung", "next_vgnkennung", "linienname", "richtung", "fahrzeugnummer", "progress", (F.col("ends") + 3_600_000).alias("expires_at")
    )


@query("live_trips", _LIVE + " SELECT * EXCLUDE progress, round(progress, 9) AS progress FROM live")
def live_trips(t: Fixtures):
    return trips_under_way(t).withColumn("progress", F.round("progress", 9))


@query("live_trips_by_next_stop", _LIVE + f", pick AS (SELECT linienname, richtung, next_vgnkennung FROM live ORDER BY 1, 2, 3 LIMIT 1) SELECT fahrtnummer FROM live JOIN pick USING (linienname, richtung, next_vgnkennung) WHERE expires_at >= {_NOW}")
def live_trips_by_next_stop(t: Fixtures):
    """Trips that come to a stop of a line; the stop asked for is the first in order, so that the answer is not empty."""
    under_way = trips_under_way(t)
    pick = under_way.select("linienname", "richtung", "next_vgnkennung").orderBy("linienname", "richtung", "next_vgnkennung").limit(1)
    return under_way.where(F.col("expires_at") >= now()).join(pick, ["linienname", "richtung", "next_vgnkennung"]).select("fahrtnummer")


@query("live_map_stops", _LIVE + " SELECT l.fahrtnummer, h.haltestellenname, n.haltestellenname AS next_haltestellenname, h.latitude, n.longitude AS next_longitude FROM live l LEFT JOIN haltestellen h ON h.vgnkennung = l.vgnkennung LEFT JOIN haltestellen n ON n.vgnkennung = l.next_vgnkennung")
def live_map_stops(t: Fixtures):
    return live.with_stops(trips_under_way(t), t.stops).select("fahrtnummer", "haltestellenname", "next_haltestellenname", "latitude", "next_longitude")


_POINTS = f", pt AS (SELECT linienname AS line, richtung AS route, pos, vgnkennung, latitude, longitude FROM {_ORDER} o JOIN haltestellen USING (vgnkennung) WHERE linienname IN ('U1', 'U2', 'U3', '4', '5', '6', '7', '8'))"
_SEGMENTS = (
    _POINTS
    + ", sg0 AS (SELECT line, route, latitude AS lat0, longitude AS lon0, lead(latitude) OVER w AS lat1, lead(longitude) OVER w AS lon1, row_number() OVER w AS seg FROM pt WINDOW w AS (PARTITION BY line, route ORDER BY pos)),"
    " sg1 AS (SELECT *, " + _haversine("6371008.8e0", "lat0", "lon0", "lat1", "lon1") + " AS metres FROM sg0 WHERE lat1 IS NOT NULL),"
    " sg AS (SELECT *, sum(metres) OVER (PARTITION BY line, route ORDER BY seg) AS cum1 FROM sg1)"
)


def geometry_points(t: Fixtures):
    """Polylines through the stops of the lines that have a geometry, one route for each direction."""
    order = line_order(t.stop_events, t.trips.where(F.col("linienname").isin("U1", "U2", "U3", "4", "5", "6", "7", "8")))
    return order.join(t.stops.select("vgnkennung", "latitude", "longitude"), "vgnkennung").select(F.col("linienname").alias("line"), F.col("richtung").alias("route"), "pos", "latitude", "longitude")


@query("line_segments", _SEGMENTS + " SELECT line, route, seg::INTEGER AS seg, round(cum1, 3) AS cum1 FROM sg")
def line_segments(t: Fixtures):
    return geometry.segments(geometry_points(t)).select("line", "route", "seg", F.round("cum1", 3).alias("cum1"))


def _estimates(t: Fixtures):
    """Trips under way with the place on their line. The trips and the segments, a dimension of the lines, are stored:
    several steps read them."""
    under_way = stored(trips_under_way(t).withColumns({"id": F.xxhash64("betriebstag", "fahrtnummer", "produkt"), "line": F.col("linienname")}), "trips-under-way")
    segs = stored(geometry.segments(geometry_points(t)), "segments")
    around = under_way.select("line", F.explode(F.array("vgnkennung", "next_vgnkennung")).alias("vgnkennung")).distinct().join(t.stops.select("vgnkennung", "latitude", "longitude"), "vgnkennung")
    return geometry.estimated(under_way, geometry.projected(around, segs), segs, F.col("progress"))


_FRACTION = (
    "CASE WHEN pow((lon1 - lon0) * cos(radians({p}.latitude)), 2) + pow(lat1 - lat0, 2) = 0 THEN 0 ELSE greatest(0, least(1, (({p}.longitude - lon0) * cos(radians({p}.latitude)) * (lon1 - lon0) * cos(radians({p}.latitude)) + ({p}.latitude - lat0) * (lat1 - lat0))"
    " / (pow((lon1 - lon0) * cos(radians({p}.latitude)), 2) + pow(lat1 - lat0, 2)))) END"
)
_MATCH = _LIVE + _SEGMENTS + (
    ", v AS (SELECT DISTINCT linienname AS line, unnest([vgnkennung, next_vgnkennung]) AS vgnkennung FROM live), pl AS (SELECT * FROM v JOIN haltestellen USING (vgnkennung)),"
    " pf AS (SELECT pl.line, pl.vgnkennung, pl.latitude, pl.longitude, route, seg, lat0, lon0, lat1, lon1, metres, cum1, " + _FRACTION.format(p="pl") + " AS f FROM pl JOIN sg USING (line)),"
    " pp AS (SELECT line, vgnkennung, route, seg, cum1 - metres + metres * f AS along, pow((longitude - (lon0 + (lon1 - lon0) * f)) * cos(radians(latitude)), 2) + pow(latitude - (lat0 + (lat1 - lat0) * f), 2) AS off2 FROM pf),"
    " pr AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY line, vgnkennung, route ORDER BY off2, seg) = 1),"
    " es AS (SELECT l.*, x.route, x.along + (y.along - x.along) * l.progress AS d FROM live l JOIN pr x ON x.line = l.linienname AND x.vgnkennung = l.vgnkennung JOIN pr y ON y.line = l.linienname AND y.vgnkennung = l.next_vgnkennung AND y.route = x.route"
    " QUALIFY row_number() OVER (PARTITION BY l.betriebstag, l.fahrtnummer, l.produkt ORDER BY x.off2 + y.off2, x.route) = 1),"
    " po AS (SELECT betriebstag, fahrtnummer, produkt, lat0 + (lat1 - lat0) * q AS est_latitude, lon0 + (lon1 - lon0) * q AS est_longitude FROM (SELECT es.betriebstag, es.fahrtnummer, es.produkt, sg.*, CASE WHEN metres = 0 THEN 0 ELSE (d - (cum1 - metres)) / metres END AS q FROM es JOIN sg ON sg.line = es.linienname AND sg.route = es.route"
    " WHERE d >= cum1 - metres OR seg = 1 QUALIFY row_number() OVER (PARTITION BY es.betriebstag, es.fahrtnummer, es.produkt ORDER BY seg DESC) = 1))"
)


@query("map_match_estimate", _MATCH + " SELECT fahrtnummer, round(est_latitude, 6) AS est_latitude, round(est_longitude, 6) AS est_longitude FROM live LEFT JOIN po USING (betriebstag, fahrtnummer, produkt)")
def map_match_estimate(t: Fixtures):
    return _estimates(t).select("fahrtnummer", F.round("est_latitude", 6).alias("est_latitude"), F.round("est_longitude", 6).alias("est_longitude"))


@query("live_map_box", _MATCH + f" SELECT l.fahrtnummer, linienname FROM live l LEFT JOIN po USING (betriebstag, fahrtnummer, produkt) LEFT JOIN haltestellen h ON h.vgnkennung = l.vgnkennung WHERE l.vgnkennung <> 0 AND coalesce(est_latitude, latitude) BETWEEN {BOX[0][0]} AND {BOX[1][0]} AND coalesce(est_longitude, longitude) BETWEEN {BOX[0][1]} AND {BOX[1][1]}")
def live_map_box(t: Fixtures):
    shown = live.displayed(live.with_stops(_estimates(t), t.stops))
    return live.asked(shown, box=BOX).select("fahrtnummer", "linienname")


@query("live_map_lines", _LIVE + " SELECT fahrtnummer, linienname FROM live WHERE vgnkennung <> 0 AND linienname IN ('U1', '5', '22')")
def live_map_lines(t: Fixtures):
    return live.asked(trips_under_way(t), lines="U1,5,22").select("fahrtnummer", "linienname")


@query("live_index_keys", _LIVE + " SELECT 'LIVE:TRIP:INDEX:' || linienname || ':' || richtung || ':' || next_vgnkennung AS key, count(*) AS n FROM live GROUP BY 1")
def live_index_keys(t: Fixtures):
    parts = [F.url_encode(F.col(c).cast("string")) for c in ("linienname", "richtung", "next_vgnkennung")]
    return trips_under_way(t).groupBy(F.concat_ws(":", F.lit("LIVE:TRIP:INDEX"), *parts).alias("key")).agg(F.count("*").alias("n"))


#: When the states were stored that a later cleaner finds run out.
STORED = f"{DAY} 06:00:00"


@query("expired_trips", _LIVE.replace(_NOW, f"epoch_ms(TIMESTAMP '{STORED}')") + f" SELECT fahrtnummer, expires_at FROM live WHERE expires_at < {_NOW} ORDER BY expires_at, fahrtnummer, betriebstag LIMIT 1000")
def expired_trips(t: Fixtures):
    """Of the states of an earlier moment the oldest thousand that have run out since, as one pass of a cleaner takes them."""
    states = trips_under_way(t, F.unix_millis(F.lit(STORED).cast("timestamp")))
    return states.where(F.col("expires_at") < now()).orderBy("expires_at", "fahrtnummer", "betriebstag").limit(1000).select("fahrtnummer", "expires_at")
