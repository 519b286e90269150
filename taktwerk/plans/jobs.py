"""Late jobs of a month's trips and the paced resolution of the trips that boards name."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktwerk.operators import jobs as op
from taktwerk.operators.trips import untracked
from taktwerk.plans.delays import in_days
from taktwerk.plans.registry import query
from taktwerk.plans.trips import STATE, rows
from taktwerk.sources.fixtures import FROM, TO, Fixtures, waited

_KEY = "betriebstag, fahrtnummer, produkt"

#: The jobs of a trip one after the other, for DuckDB.
CHAIN = STATE + f""", q AS (SELECT {_KEY}, vgnkennung, idx, last_idx, coalesce(ab_soll, an_soll) AS planned, ab_ist AS actual,
    CASE WHEN (fahrtnummer::BIGINT * 31 + vgnkennung::BIGINT * 17) % 40 = 0 THEN 200000 ELSE (fahrtnummer::BIGINT * 31 + vgnkennung::BIGINT * 17) % 36000 END AS wait,
    (fahrtnummer::BIGINT * 31 + vgnkennung::BIGINT * 17) * 7 % 1200 + CASE WHEN (fahrtnummer::BIGINT * 31 + vgnkennung::BIGINT * 17) % 50 = 0 THEN 40000 ELSE 0 END AS req FROM a),
tries AS (SELECT x.*, y.planned AS n_planned, y.actual AS n_actual, x.planned - 30000 + x.wait AS t1 FROM q x LEFT JOIN q y ON x.betriebstag = y.betriebstag AND x.fahrtnummer = y.fahrtnummer AND x.produkt = y.produkt AND y.idx = x.idx + 1),
look AS (SELECT *, CASE WHEN wait > 30000 THEN CASE WHEN idx + 1 >= last_idx THEN 'finished' ELSE 'late' END WHEN actual BETWEEN t1 AND t1 + 300000 THEN 'found' WHEN req >= 30000 THEN 'slow' WHEN idx >= last_idx THEN 'finished' END AS one,
    CASE WHEN wait + req > 30000 THEN CASE WHEN idx + 1 >= last_idx THEN 'finished' ELSE 'late' END WHEN actual BETWEEN t1 + req AND t1 + req + 300000 THEN 'found' WHEN idx + 1 >= last_idx THEN 'finished'
         WHEN n_actual BETWEEN t1 + 2 * req AND t1 + 2 * req + 1200000 THEN 'ahead' ELSE 'lost' END AS two FROM tries),
did AS (SELECT *, coalesce(one, two) AS outcome, CASE WHEN one IS NULL THEN 2 ELSE 1 END AS attempts FROM look),
del AS (SELECT *, n_planned - 30000 - (t1 + CASE WHEN attempts = 2 THEN req ELSE 0 END) - CASE WHEN outcome = 'late' THEN 0 ELSE 2 * req END AS delay FROM did),
run AS (SELECT {_KEY}, vgnkennung, idx, attempts, outcome, delay, last_idx FROM del WHERE idx = 0
    UNION ALL SELECT d.betriebstag, d.fahrtnummer, d.produkt, d.vgnkennung, d.idx, d.attempts, d.outcome, d.delay, d.last_idx FROM run r JOIN del d ON d.betriebstag = r.betriebstag AND d.fahrtnummer = r.fahrtnummer AND d.produkt = r.produkt AND d.idx = r.idx + 1
    WHERE r.outcome IN ('found', 'late', 'slow') AND r.delay >= 10000),
job AS (SELECT {_KEY}, vgnkennung, idx::INTEGER AS idx, attempts, outcome, CASE WHEN outcome = 'ahead' THEN 'kept' WHEN outcome IN ('lost', 'finished') OR idx = last_idx THEN 'ended' WHEN delay >= 10000 THEN 'scheduled' ELSE 'dropped' END AS follows, delay FROM run)
"""


def chain(t: Fixtures):
    """The jobs of the trips of the days."""
    wait, request = waited()
    stops = rows(t).withColumns({"planned": F.coalesce("ab_soll", "an_soll"), "actual": F.col("ab_ist"), "wait_ms": wait, "request_ms": request})
    return op.late_jobs(stops)


@query("late_jobs", CHAIN + f" SELECT {_KEY}, idx, attempts, outcome, CASE WHEN follows = 'scheduled' THEN delay END AS next_delay_ms, follows FROM job", recursive=True)
def late_jobs(t: Fixtures):
    return chain(t)


@query("late_job_counts", CHAIN + " SELECT outcome, follows, count(*) AS n, count(*) FILTER (WHERE attempts = 2) AS retried FROM job GROUP BY 1, 2", recursive=True)
def late_job_counts(t: Fixtures):
    """Jobs by what became of them."""
    return chain(t).groupBy("outcome", "follows").agg(F.count("*").alias("n"), F.count_if(F.col("attempts") == 2).alias("retried"))


#: A lane pauses so long between two trips.
PAUSE_MS = 4_000

#: A trip is asked for once, when the first board names it; boards are read at the start of each day.
_QUEUE = f""", dq AS (SELECT fahrtnummer, min(produkt) AS produkt, min(epoch_ms(betriebstag::TIMESTAMP)) AS arrived_ms FROM fahrten_halte WHERE betriebstag BETWEEN DATE '{FROM}' AND DATE '{TO}' AND fahrtnummer NOT IN (SELECT fahrtnummer FROM fahrten WHERE fahrtnummer % 3 = 0) GROUP BY 1),
nq AS (SELECT *, row_number() OVER (PARTITION BY produkt ORDER BY arrived_ms, fahrtnummer) AS i FROM dq),
pc AS (SELECT fahrtnummer, produkt, arrived_ms, i, arrived_ms AS starts_ms FROM nq WHERE i = 1
    UNION ALL SELECT n.fahrtnummer, n.produkt, n.arrived_ms, n.i, greatest(n.arrived_ms, p.starts_ms + {PAUSE_MS}) AS starts_ms FROM pc p JOIN nq n ON n.produkt = p.produkt AND n.i = p.i + 1)
"""


def discovered(t: Fixtures):
    """(fahrtnummer, produkt, arrived_ms): trips that boards name and nobody tracks; those of every third number are tracked."""
    tracked = t.trips.where("fahrtnummer % 3 = 0").select("fahrtnummer")
    named = untracked(t.stop_events.where(in_days()), tracked)
    return named.groupBy("fahrtnummer").agg(F.min("produkt").alias("produkt"), F.min(F.unix_millis(F.col("betriebstag").cast("timestamp"))).alias("arrived_ms"))


@query("resolution_times", _QUEUE + " SELECT fahrtnummer, produkt, arrived_ms, starts_ms FROM pc", recursive=True)
def resolution_times(t: Fixtures):
    """When each discovered trip is resolved, a lane for each mode."""
    return op.paced(discovered(t), "produkt", "arrived_ms", "fahrtnummer", PAUSE_MS)


@query("resolution_delays", _QUEUE + " SELECT produkt, count(*) AS n, count(*) FILTER (WHERE starts_ms > arrived_ms) AS waited, max(starts_ms - arrived_ms) AS longest_ms FROM pc GROUP BY 1", recursive=True)
def resolution_delays(t: Fixtures):
    """How many trips of a mode had to wait for the budget, and how long at most."""
    wait = F.col("starts_ms") - F.col("arrived_ms")
    return resolution_times(t).groupBy("produkt").agg(F.count("*").alias("n"), F.count_if(wait > 0).alias("waited"), F.max(wait).alias("longest_ms"))
