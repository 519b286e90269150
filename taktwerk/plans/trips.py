"""Trips under way, evaluated at a moment of the service day."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktwerk.functions import timing
from taktwerk.operators import trips as op
from taktwerk.plans.delays import day_is, in_days
from taktwerk.plans.registry import query
from taktwerk.sources.fixtures import DAY, FROM, TO, Fixtures

NOON = f"{DAY} 10:00:00"
_NOW = f"epoch_ms(TIMESTAMP '{NOON}')"

#: Itineraries and their state at the moment, for DuckDB.
STATE = f""", i AS (SELECT fahrtnummer, betriebstag, produkt, vgnkennung, epoch_ms(ankunft_soll) AS an_soll, epoch_ms(abfahrt_soll) AS ab_soll, epoch_ms(ankunft_soll) + ankunft_v::BIGINT * 1000 AS an_ist, epoch_ms(abfahrt_soll) + abfahrt_v::BIGINT * 1000 AS ab_ist,
    row_number() OVER (PARTITION BY betriebstag, fahrtnummer, produkt ORDER BY coalesce(ankunft_soll, abfahrt_soll) NULLS LAST, vgnkennung) - 1 AS idx FROM fahrten_halte WHERE betriebstag BETWEEN DATE '{FROM}' AND DATE '{TO}'),
a AS (SELECT *, coalesce(an_ist, an_soll, ab_ist, ab_soll) AS arrival, lead(vgnkennung) OVER w AS n_vgn, lead(an_ist) OVER w AS n_an_ist, lead(an_soll) OVER w AS n_an_soll, lead(ab_ist) OVER w AS n_ab_ist, lead(ab_soll) OVER w AS n_ab_soll,
    max(idx) OVER (PARTITION BY betriebstag, fahrtnummer, produkt) AS last_idx FROM i WINDOW w AS (PARTITION BY betriebstag, fahrtnummer, produkt ORDER BY idx)),
f AS (SELECT betriebstag, fahrtnummer, produkt, max(idx) FILTER (WHERE arrival <= {_NOW} OR idx = 0) AS idx FROM a GROUP BY 1, 2, 3),
s AS (SELECT *, coalesce(ab_ist, ab_soll) - greatest(coalesce(n_an_soll - n_an_ist, 0), 0) AS l, coalesce(an_ist, an_soll) AS c, coalesce(n_an_ist, n_an_soll, n_ab_ist, n_ab_soll) AS n_arr, coalesce(n_an_ist, n_ab_ist, n_an_soll, n_ab_soll) AS n_stop FROM a JOIN f USING (betriebstag, fahrtnummer, produkt, idx)),
state AS (SELECT *, idx = last_idx AS finished, CASE WHEN l IS NULL THEN c WHEN c IS NULL THEN l ELSE greatest(l, c) END AS st FROM s)
"""


def now():
    """The moment at which trips are evaluated, in milliseconds."""
    return F.unix_millis(F.lit(NOON).cast("timestamp"))


def rows(t: Fixtures):
    return op.itineraries(t.stop_events.where(in_days()))


@query("trip_progress_asof", STATE + f" SELECT betriebstag, fahrtnummer, produkt, vgnkennung, n_vgn AS next_vgnkennung, idx::INTEGER AS idx, finished, CASE WHEN finished OR st IS NULL OR n_arr IS NULL OR n_arr <= st THEN 0e0 ELSE round(greatest(0, least(1, ({_NOW} - st) / (n_arr - st)::DOUBLE)), 9) END AS progress FROM state")
def trip_progress_asof(t: Fixtures):
    return op.at(rows(t), now()).select("betriebstag", "fahrtnummer", "produkt", "vgnkennung", "next_vgnkennung", "idx", "finished", F.round("progress", 9).alias("progress"))


@query("trip_next_run", STATE + f" SELECT betriebstag, fahrtnummer, produkt, (CASE WHEN n_stop > st AND st + (n_stop - st) / 2e0 > {_NOW} THEN st + (n_stop - st) / 2e0 WHEN n_stop > {_NOW} THEN n_stop WHEN n_stop IS NOT NULL THEN {_NOW} + 30000 ELSE {_NOW} + 300000 END)::DOUBLE AS next_run FROM state WHERE NOT finished")
def trip_next_run(t: Fixtures):
    return op.at(rows(t), now()).where("not finished").select("betriebstag", "fahrtnummer", "produkt", "next_run")


_REACHED = STATE + f", r AS (SELECT betriebstag, fahrtnummer, produkt, list(vgnkennung ORDER BY idx) AS reached FROM a WHERE arrival <= {_NOW} GROUP BY 1, 2, 3)"


@query("pending_stops_except", _REACHED + " SELECT betriebstag, fahrtnummer, produkt, array_to_string(list_filter(reached, lambda x: x <> reached[1]), ',') AS pending FROM r")
def pending_stops_except(t: Fixtures):
    """Reached stops without those recorded before; here the first of each trip is recorded."""
    state = op.at(rows(t), now()).where(F.size("reached") > 0)
    left = op.pending(F.col("reached"), F.slice("reached", 1, 1))
    return state.select("betriebstag", "fahrtnummer", "produkt", F.array_join(F.transform(left, lambda x: x.cast("string")), ",").alias("pending"))


@query("trip_endpoints", STATE + " SELECT betriebstag, fahrtnummer, produkt, min(arrival) AS starts, max(arrival) AS ends FROM a GROUP BY 1, 2, 3")
def trip_endpoints(t: Fixtures):
    return op.at(rows(t), now()).select("betriebstag", "fahrtnummer", "produkt", "starts", "ends")


@query("active_trips", STATE + f", e AS (SELECT betriebstag, fahrtnummer, produkt, min(arrival) AS x, max(arrival) AS y FROM a GROUP BY 1, 2, 3) SELECT produkt, count(*) AS known, count(*) FILTER (WHERE {_NOW} BETWEEN x AND y) AS active FROM e GROUP BY 1")
def active_trips(t: Fixtures):
    return op.at(rows(t), now()).groupBy("produkt").agg(F.count("*").alias("known"), F.count_if(now().between(F.col("starts"), F.col("ends"))).alias("active"))


@query("unfinished_trips", STATE + f", e AS (SELECT betriebstag, fahrtnummer, produkt, max(arrival) AS y FROM a GROUP BY 1, 2, 3) SELECT * EXCLUDE y FROM e WHERE y > {_NOW}")
def unfinished_trips(t: Fixtures):
    return op.at(rows(t), now()).where(F.col("ends") > now()).select("betriebstag", "fahrtnummer", "produkt")


@query("first_future_stop", STATE + f" SELECT e.betriebstag, e.fahrtnummer, e.produkt, coalesce(min(a.idx) FILTER (WHERE a.ab_soll > {_NOW} + 60000), -1)::INTEGER AS pos FROM a e JOIN a USING (betriebstag, fahrtnummer, produkt) WHERE e.idx = 0 GROUP BY 1, 2, 3")
def first_future_stop(t: Fixtures):
    """The first stop at least a minute ahead, -1 where there is none."""
    ahead = F.min(F.when(F.col("ab_soll") > now() + 60_000, F.col("idx")))
    return rows(t).groupBy("betriebstag", "fahrtnummer", "produkt").agg(F.coalesce(ahead, F.lit(-1)).alias("pos"))


@query("ingested_delays", STATE + " SELECT betriebstag, fahrtnummer, produkt, vgnkennung, (CASE WHEN an_ist IS NULL THEN 0 ELSE floor((an_ist - an_soll) / 1000) END)::INTEGER AS ankunft_v FROM a")
def ingested_delays(t: Fixtures):
    """Delays as they are stored: none counts as 0."""
    return rows(t).select("betriebstag", "fahrtnummer", "produkt", "vgnkennung", timing.delay_seconds(F.col("an_soll"), F.col("an_ist")).alias("ankunft_v"))


@query("new_trips_antijoin", f"SELECT fahrtnummer, betriebstag FROM fahrten WHERE betriebstag BETWEEN DATE '{FROM}' AND DATE '{TO}' AND fahrtnummer NOT IN (SELECT fahrtnummer FROM fahrten WHERE produkt = 1)")
def new_trips_antijoin(t: Fixtures):
    return op.untracked(t.trips.where(in_days()), t.trips.where("produkt = 1")).select("fahrtnummer", "betriebstag")


@query("trips_to_track", f"SELECT fahrtnummer, faelltaus = 0 AS tracked FROM fahrten WHERE betriebstag BETWEEN DATE '{FROM}' AND DATE '{TO}'")
def trips_to_track(t: Fixtures):
    """Cancelled trips are stored but not tracked."""
    return t.trips.where(in_days()).select("fahrtnummer", (F.col("faelltaus") == 0).alias("tracked"))


@query("learned_stops", f"SELECT DISTINCT vgnkennung FROM fahrten_halte WHERE betriebstag = DATE '{DAY}'")
def learned_stops(t: Fixtures):
    return t.stop_events.where(day_is()).select("vgnkennung").distinct()
