"""Lines, hourly profiles and punctuality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taktwerk.operators import delays as op
from taktwerk.operators.stops import line_order
from taktwerk.plans.registry import query
from taktwerk.sources.fixtures import AS_OF, LINE, Fixtures

def as_of():
    """The day on which "today" is set."""
    return F.lit(AS_OF).cast("date")


@query("distinct_lines", "SELECT DISTINCT linienname FROM fahrten")
def distinct_lines(t: Fixtures):
    return t.trips.select("linienname").distinct()


@query("lines_containing", "SELECT DISTINCT linienname FROM fahrten WHERE contains(lower(linienname), 'u')")
def lines_containing(t: Fixtures):
    return t.trips.select("linienname").where(F.lower("linienname").contains("u")).distinct()


# a line's days reach far back here, since the fixture has few trips a day
DAYS = 180 * 10
_PROFILE = (
    "SELECT vgnkennung, haltestellenname, latitude, longitude, richtung, coalesce((hour(ankunft_soll) + 1) % 24, 0)::INTEGER AS time_bucket, count(*) AS trip_count,"
    " coalesce(avg(ankunft_v), 0) AS avg_arrival_delay, coalesce(avg(abfahrt_v), 0) AS avg_departure_delay FROM fahrten_halte JOIN fahrten USING (fahrtnummer, betriebstag, produkt) JOIN haltestellen USING (vgnkennung)"
    f" WHERE linienname = '{LINE}' AND betriebstag >= DATE '{AS_OF}' - {DAYS} GROUP BY ALL"
)


def _profile(t: Fixtures):
    return op.line_profile(t.stop_events, t.trips, t.stops, LINE, F.date_sub(as_of(), DAYS))


@query("line_hour_profile", _PROFILE)
def line_hour_profile(t: Fixtures):
    return _profile(t)


@query("line_hour_profile_pivot", f", p AS ({_PROFILE}) SELECT vgnkennung, richtung, " + ", ".join(f"max(CASE WHEN time_bucket = {h} THEN avg_arrival_delay END) AS h{h}" for h in range(24)) + " FROM p GROUP BY 1, 2")
def line_hour_profile_pivot(t: Fixtures):
    wide = _profile(t).groupBy("vgnkennung", "richtung").pivot("time_bucket", list(range(24))).agg(F.max("avg_arrival_delay"))
    return wide.select("vgnkennung", "richtung", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


@query("line_profile_range", f", p AS ({_PROFILE}) SELECT richtung, min(avg_arrival_delay) AS lo, max(avg_arrival_delay) AS hi FROM p GROUP BY 1")
def line_profile_range(t: Fixtures):
    return _profile(t).groupBy("richtung").agg(F.min("avg_arrival_delay").alias("lo"), F.max("avg_arrival_delay").alias("hi"))


_ORDER = (
    "(SELECT linienname, richtung, vgnkennung, (row_number() OVER (PARTITION BY linienname, richtung ORDER BY first_time, vgnkennung))::INTEGER AS pos FROM (SELECT linienname, richtung, vgnkennung,"
    " min(coalesce(ankunft_soll, abfahrt_soll)::TIME) AS first_time FROM fahrten_halte JOIN fahrten USING (fahrtnummer, betriebstag, produkt) GROUP BY 1, 2, 3))"
)


@query("line_station_order", f"SELECT * FROM {_ORDER}")
def line_station_order(t: Fixtures):
    return line_order(t.stop_events, t.trips)


@query("line_profile_in_order", f", p AS ({_PROFILE}) SELECT o.pos, p.vgnkennung, p.richtung, time_bucket, avg_arrival_delay FROM p JOIN {_ORDER} o ON o.linienname = '{LINE}' AND o.richtung = p.richtung AND o.vgnkennung = p.vgnkennung")
def line_profile_in_order(t: Fixtures):
    order = line_order(t.stop_events, t.trips.where(F.col("linienname") == LINE)).select("richtung", "vgnkennung", "pos")
    return _profile(t).join(order, ["richtung", "vgnkennung"]).select("pos", "vgnkennung", "richtung", "time_bucket", "avg_arrival_delay")


_SHARES = ", ".join(f"count(*) FILTER (WHERE abfahrt_v BETWEEN {lo} AND {hi}) * 1e2 / count(*) AS percentage_{n}" for n, lo, hi in (("early", -900, -60), ("on_time", -60, 180), ("late", 180, 900)))
_PUNCTUAL = "SELECT {} produkt, count(*) AS total_departures, " + _SHARES + " FROM fahrten_halte JOIN fahrten USING (fahrtnummer, betriebstag, produkt) WHERE abfahrt_v IS NOT NULL AND betriebstag >= DATE '" + AS_OF + "' - INTERVAL {} YEAR GROUP BY ALL"


@query("punctuality_month", _PUNCTUAL.format("date_trunc('month', betriebstag)::DATE AS month,", 10))
def punctuality_month(t: Fixtures):
    rows = op.punctuality(t.stop_events, t.trips, as_of(), [F.trunc("betriebstag", "MM").alias("month")], years=10)
    return rows.orderBy(F.desc("month"), "produkt")


@query("punctuality_week", _PUNCTUAL.format("year(betriebstag)::INTEGER AS year, week(betriebstag)::INTEGER AS calendar_week,", 10))
def punctuality_week(t: Fixtures):
    rows = op.punctuality(t.stop_events, t.trips, as_of(), [F.year("betriebstag").alias("year"), F.weekofyear("betriebstag").alias("calendar_week")], years=10)
    return rows.orderBy(F.desc("year"), F.desc("calendar_week"), "produkt")


@query("punctuality_last_year", _PUNCTUAL.format("date_trunc('month', betriebstag)::DATE AS month,", 1))
def punctuality_last_year(t: Fixtures):
    return op.punctuality(t.stop_events, t.trips, as_of(), [F.trunc("betriebstag", "MM").alias("month")])


_MONTHS = _PUNCTUAL.format("date_trunc('month', betriebstag)::DATE AS month,", 10)


@query("punctuality_series", f", p AS ({_MONTHS}) SELECT month, max(CASE WHEN produkt = 1 THEN percentage_on_time END) AS bus, max(CASE WHEN produkt = 2 THEN percentage_on_time END) AS ubahn, max(CASE WHEN produkt = 3 THEN percentage_on_time END) AS tram FROM p GROUP BY 1")
def punctuality_series(t: Fixtures):
    """A column for each product, by month."""
    wide = punctuality_month(t).groupBy("month").pivot("produkt", [1, 2, 3]).agg(F.max("percentage_on_time"))
    return wide.select("month", F.col("1").alias("bus"), F.col("2").alias("ubahn"), F.col("3").alias("tram"))


@query("punctuality_axis", f", p AS ({_MONTHS}) SELECT least(ceil(1.5e0 * greatest(max(percentage_on_time), 1)), 100)::DOUBLE AS axis_max FROM p WHERE produkt IN (1, 2, 3)")
def punctuality_axis(t: Fixtures):
    return punctuality_month(t).where("produkt in (1, 2, 3)").agg(F.least(F.ceil(1.5 * F.greatest(F.max("percentage_on_time"), F.lit(1.0))), F.lit(100)).cast("double").alias("axis_max"))


@query("punctuality_labels", f", p AS ({_PUNCTUAL.format('year(betriebstag)::INTEGER AS year, week(betriebstag)::INTEGER AS calendar_week,', 10)}) SELECT 'W' || calendar_week || ', ' || year AS label, (row_number() OVER (ORDER BY year, calendar_week))::INTEGER AS pos FROM (SELECT DISTINCT year, calendar_week FROM p)")
def punctuality_labels(t: Fixtures):
    """Distinct week labels from the oldest on; their number is that of weeks, so one window takes them."""
    weeks = punctuality_week(t).select("year", "calendar_week").distinct()
    pos = F.row_number().over(Window.orderBy("year", "calendar_week"))
    return weeks.select(F.concat(F.lit("W"), "calendar_week", F.lit(", "), "year").alias("label"), pos.alias("pos"))
