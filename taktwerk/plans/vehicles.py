"""Vehicle histories, distances and what vehicles served."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taktwerk.operators import vehicles as op
from taktwerk.plans.delays import day_is
from taktwerk.plans.registry import query
from taktwerk.plans.stops import _haversine
from taktwerk.sources.fixtures import DAY, VEHICLE, Fixtures
from taktwerk.sources.schema import TRIP_KEY

_ROWS = (
    ", p AS (SELECT *, coalesce(abfahrt_soll, ankunft_soll) AS zeitpunkt FROM fahrten_halte JOIN fahrten USING (fahrtnummer, betriebstag, produkt) JOIN haltestellen USING (vgnkennung) WHERE {}),"
    " w AS (SELECT *, row_number() OVER r AS pos, lag(latitude) OVER r AS lat0, lag(longitude) OVER r AS lon0, lag(linienname) OVER r AS line0, lag(haltestellenname) OVER r AS name0 FROM p"
    " WINDOW r AS (PARTITION BY betriebstag, fahrzeugnummer ORDER BY zeitpunkt NULLS LAST, fahrtnummer, vgnkennung)),"
    " l AS (SELECT *, round(" + _haversine("6371000e0", "lat0", "lon0", "latitude", "longitude") + ")::BIGINT AS metres FROM w)"
)
_ALL_DAYS = f"fahrzeugnummer = {VEHICLE}"
_ONE_DAY = f"betriebstag = DATE '{DAY}' AND fahrzeugnummer NOT IN (0, -1)"


def _own(t: Fixtures, vehicle: int = VEHICLE):
    return op.positions(t.stop_events, t.trips, t.stops, F.lit(True), F.col("fahrzeugnummer") == vehicle)


def _day(t: Fixtures):
    return op.positions(t.stop_events, t.trips, t.stops, day_is(), ~F.col("fahrzeugnummer").isin(*op.NO_VEHICLE))


_HISTORY = ("haltestellenname", "latitude", "longitude", "zeitpunkt", "linienname", "produkt", "besetzungsgrad", "ankunft_soll", "ankunft_v", "abfahrt_soll", "abfahrt_v")


@query("vehicle_history", _ROWS.format(_ALL_DAYS) + " SELECT " + ", ".join(_HISTORY) + " FROM p ORDER BY zeitpunkt")
def vehicle_history(t: Fixtures):
    return _own(t).orderBy(F.col("zeitpunkt").asc_nulls_last(), "fahrtnummer", "vgnkennung").select(*_HISTORY)


@query("vehicle_positions", _ROWS.format(_ONE_DAY) + " SELECT fahrzeugnummer, latitude, longitude, zeitpunkt FROM p")
def vehicle_positions(t: Fixtures):
    return _day(t).select("fahrzeugnummer", "latitude", "longitude", "zeitpunkt").orderBy("fahrzeugnummer", F.col("zeitpunkt").asc_nulls_last())


@query("vehicle_distance", _ROWS.format(_ONE_DAY) + " SELECT fahrzeugnummer, coalesce(sum(metres), 0)::BIGINT AS distance_m FROM l GROUP BY 1")
def vehicle_distance(t: Fixtures):
    return op.legs(_day(t)).groupBy("fahrzeugnummer").agg(F.coalesce(F.sum("metres"), F.lit(0)).alias("distance_m")).orderBy(F.desc("distance_m"), "fahrzeugnummer")


@query("vehicle_km_by_line", _ROWS.format(_ALL_DAYS) + " SELECT betriebstag, linienname, round(coalesce(sum(metres) FILTER (WHERE line0 = linienname), 0) / 1e3, 3) AS km FROM l GROUP BY 1, 2")
def vehicle_km_by_line(t: Fixtures):
    """Kilometres by line; the way to the first stop after a change of line counts for none."""
    on_line = F.sum(F.when(F.col("vor_linienname") == F.col("linienname"), F.col("metres")))
    return op.legs(_own(t)).groupBy("betriebstag", "linienname").agg(F.round(F.coalesce(on_line, F.lit(0)) / 1000, 3).alias("km"))


@query("vehicle_running_km", _ROWS.format(_ALL_DAYS) + " SELECT betriebstag, pos::INTEGER AS pos, coalesce(sum(metres) OVER (PARTITION BY betriebstag ORDER BY pos), 0) / 1e3 AS km FROM l")
def vehicle_running_km(t: Fixtures):
    return op.running_metres(_own(t)).select("betriebstag", "pos", (F.col("so_far") / 1000).alias("km"))


@query("vehicle_edge_counts", _ROWS.format(_ALL_DAYS) + " SELECT betriebstag, name0 AS von, haltestellenname AS nach, count(*) AS n FROM l WHERE pos > 1 GROUP BY 1, 2, 3")
def vehicle_edge_counts(t: Fixtures):
    return op.edges(_own(t)).groupBy("betriebstag", F.col("vor_haltestellenname").alias("von"), F.col("haltestellenname").alias("nach")).agg(F.max("n").cast("bigint").alias("n"))


@query("vehicle_first_visits", _ROWS.format(_ALL_DAYS) + " SELECT betriebstag, longitude, latitude, min(pos)::INTEGER AS pos FROM l GROUP BY 1, 2, 3")
def vehicle_first_visits(t: Fixtures):
    first = Window.partitionBy("betriebstag", "longitude", "latitude").orderBy("pos")
    return op.legs(_own(t)).withColumn("k", F.row_number().over(first)).where("k = 1").select("betriebstag", "longitude", "latitude", "pos")




@query("served_lines", f"SELECT array_to_string(coalesce(list_sort(list(DISTINCT linienname)), []), ',') AS linien FROM fahrten WHERE fahrzeugnummer = {VEHICLE}")
def served_lines(t: Fixtures):
    """One row, also for a vehicle that served none."""
    return t.trips.where(F.col("fahrzeugnummer") == VEHICLE).agg(F.array_join(F.array_sort(F.collect_set("linienname")), ",").alias("linien"))


@query("served_lines_none", "SELECT array_to_string(coalesce(list_sort(list(DISTINCT linienname)), []), ',') AS linien FROM fahrten WHERE fahrzeugnummer = -5")
def served_lines_none(t: Fixtures):
    return t.trips.where("fahrzeugnummer = -5").agg(F.array_join(F.array_sort(F.collect_set("linienname")), ",").alias("linien"))


@query("served_stops", f"SELECT DISTINCT haltestellenname, latitude, longitude, vgnkennung, array_to_string(vagkennung, ' ') AS vagkennung FROM fahrten JOIN fahrten_halte USING (fahrtnummer, betriebstag, produkt) JOIN haltestellen USING (vgnkennung) WHERE fahrzeugnummer = {VEHICLE}")
def served_stops(t: Fixtures):
    own = t.trips.where(F.col("fahrzeugnummer") == VEHICLE).select(*TRIP_KEY)
    ids = t.stop_events.join(own, list(TRIP_KEY)).select("vgnkennung").distinct()
    return t.stops.join(ids, "vgnkennung").select("haltestellenname", "latitude", "longitude", "vgnkennung", F.array_join("vagkennung", " ").alias("vagkennung"))


@query("vehicle_info", "SELECT DISTINCT fahrzeugnummer, CASE WHEN fahrzeugnummer > 0 THEN 'typ' || (fahrzeugnummer % 3) END AS typ FROM fahrten")
def vehicle_info(t: Fixtures):
    """Vehicles beside their master data; those without keep their row."""
    seen = t.trips.select("fahrzeugnummer").distinct()
    master = seen.where("fahrzeugnummer > 0").select("fahrzeugnummer", F.concat(F.lit("typ"), (F.col("fahrzeugnummer") % 3).cast("string")).alias("typ"))
    return seen.join(master, "fahrzeugnummer", "left")
