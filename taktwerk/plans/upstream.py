"""Upstream answers read as a data source, tracked trips, and streams into versioned tables.

The answers are those that the upstream would give of the fixtures. A plan keeps them in a folder of its own in the
shared folder and reads them back as a table or a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.plans.registry import query
from taktwerk.sources import feeds, upstream
from taktwerk.sources.fixtures import FROM, TO, Fixtures
from taktwerk.sources.scratch import shared_folder
from taktwerk.streaming import sinks, tracking
from taktwerk.streaming.run import read_up, table_stream

DAYS = f"BETWEEN DATE '{FROM}' AND DATE '{TO}'"
EXPORTED = 801_964_800_000  # the poll of the stop list


def kept(t: Fixtures, kind: str, answers: DataFrame) -> str:
    folder = shared_folder(t.spark, "upstream")
    upstream.keep(answers, folder, kind)
    return folder


# ---------------------------------------------------------------- reading


@query("upstream_active_trips", f"SELECT fahrtnummer, betriebstag, produkt, linienname, CASE WHEN besetzungsgrad <= 4 THEN besetzungsgrad ELSE 0 END AS besetzungsgrad, fahrzeugnummer, richtung, faelltaus, epoch_ms(betriebstag::TIMESTAMP) AS starts FROM fahrten WHERE betriebstag {DAYS}")
def upstream_active_trips(t: Fixtures):
    """Polls of the active trips of each mode, brought to rows of the trip table; an unknown occupancy is 0."""
    feed = upstream.reader(t.spark, kept(t, "trips", t.trips_answers(FROM, TO)), "trips")
    return feeds.active_trips(feed).drop("ends", "poll")


@query("upstream_stops", "SELECT vgnkennung, array_to_string(vagkennung, ',') AS vagkennung, haltestellenname, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, produkt_bus, produkt_ubahn, produkt_tram, produkt_sbahn, produkt_rbahn FROM haltestellen")
def upstream_stops(t: Fixtures):
    feed = upstream.reader(t.spark, kept(t, "stops", t.stops_answers(EXPORTED)), "stops")
    return feeds.listed_stops(feed, t.stop_type).drop("poll").withColumns({"vagkennung": F.array_join("vagkennung", ","), "latitude": F.round("latitude", 9), "longitude": F.round("longitude", 9)})


# ---------------------------------------------------------------- streams into tables

TRIP_VERSIONS = "fahrtnummer int, betriebstag date, produkt tinyint, linienname string, besetzungsgrad tinyint, fahrzeugnummer int, richtung tinyint, faelltaus smallint, poll bigint"
STOP_VERSIONS = "fahrtnummer int, betriebstag date, produkt tinyint, vgnkennung {}, haltepunkt smallint, ankunft_soll timestamp_ntz, ankunft_v smallint, abfahrt_soll timestamp_ntz, abfahrt_v smallint, poll bigint"


def halves(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What came before the noon of the first day and what came after, so that a stream reads it in two batches."""
    noon = F.unix_millis(F.lit(f"{FROM} 06:00:00").cast("timestamp"))
    return answers.where(F.col("poll") <= noon), answers.where(F.col("poll") > noon)


def upserted(t: Fixtures, kind: str, answers: DataFrame, rows, table: sinks.Table) -> DataFrame:
    """A table that two runs of a stream have filled and a compaction has cleaned up; each batch is written twice."""
    folder = shared_folder(t.spark, "upstream")
    write = table.sink("feed")

    def twice(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)

    for some in halves(answers):
        upstream.keep(some, folder, kind)
        read_up(rows(upstream.reader(t.spark, folder, kind, stream=True)), twice, f"{folder}/checkpoint")
    table.compact(t.spark)
    table.vacuum(t.spark)
    return table.latest(t.spark)


@query("stream_upserted_trips", f"SELECT fahrtnummer, betriebstag, produkt, linienname, CASE WHEN besetzungsgrad <= 4 THEN besetzungsgrad ELSE 0 END AS besetzungsgrad, fahrzeugnummer, richtung, faelltaus FROM fahrten WHERE betriebstag {DAYS}")
def stream_upserted_trips(t: Fixtures):
    table = sinks.Table(shared_folder(t.spark, "table"), TRIP_VERSIONS, ("betriebstag", "fahrtnummer", "produkt"), ("poll",), "betriebstag")
    return upserted(t, "trips", t.trips_answers(FROM, TO), lambda feed: feeds.active_trips(feed).drop("starts", "ends"), table).drop("poll")


@query("stream_upserted_stop_events", f"SELECT fahrtnummer, betriebstag, produkt, vgnkennung, haltepunkt, ankunft_soll, CASE WHEN ankunft_soll IS NOT NULL THEN coalesce(ankunft_v, 0) END::SMALLINT AS ankunft_v, abfahrt_soll, CASE WHEN abfahrt_soll IS NOT NULL THEN coalesce(abfahrt_v, 0) END::SMALLINT AS abfahrt_v FROM fahrten_halte WHERE betriebstag {DAYS}")
def stream_upserted_stop_events(t: Fixtures):
    """Stop events as they were at noon: planned at first, then with their delays, of which none counts as 0."""
    table = sinks.Table(shared_folder(t.spark, "table"), STOP_VERSIONS.format(t.event_stop_type), ("betriebstag", "vgnkennung", "fahrtnummer", "produkt"), ("poll",), "betriebstag")
    return upserted(t, "trip", t.trip_answers(FROM, TO), lambda feed: feeds.stop_events(feed, t.event_stop_type).drop("idx", "richtungstext").where("fahrtnummer > 0"), table).drop("poll")


@query("stream_metric_gauges", "SELECT event_type, count(*) AS points, arg_max(value, event_id) AS gauge FROM events GROUP BY 1", prelude=False)
def stream_metric_gauges(t: Fixtures):
    """Points appended to a list, and the latest of each key as its gauge."""
    points = sinks.Table(shared_folder(t.spark, "table"), "event_type string, value double, event_id bigint")
    gauges = sinks.Table(shared_folder(t.spark, "table"), points.schema, ("event_type",), ("event_id",))
    add, put = points.sink("metrics"), gauges.sink("metrics")

    def both(batch: DataFrame, number: int) -> None:
        add(batch, number)
        put(batch.groupBy("event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id")), number)

    read_up(table_stream(t.spark, t.sf_dir, "events").select("event_type", "value", "event_id"), both, shared_folder(t.spark, "checkpoint"))
    counts = points.rows(t.spark).groupBy("event_type").agg(F.count("*").alias("points"))
    return counts.join(gauges.latest(t.spark).select("event_type", F.col("value").alias("gauge")), "event_type")


@query("stream_trace_status", "SELECT event_type, count(*) AS events, sum(length(props)) AS bytes FROM events GROUP BY 1", prelude=False)
def stream_trace_status(t: Fixtures):
    """A trace that is on: its rows and bytes by operation."""
    settings = sinks.Table(shared_folder(t.spark, "table"), "key string, value string, at bigint", ("key",), ("at",))
    settings.sink("settings")(t.spark.createDataFrame([("trace", "1", 0)], settings.schema), 0)
    trace = sinks.Table(shared_folder(t.spark, "table"), "event_type string, bytes bigint")
    write = sinks.switched(trace.sink("trace"), sinks.switch(settings, "trace"))
    rows = table_stream(t.spark, t.sf_dir, "events").select("event_type", F.length("props").cast("bigint").alias("bytes"))
    read_up(rows, write, shared_folder(t.spark, "checkpoint"))
    return trace.rows(t.spark).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"))


# ---------------------------------------------------------------- tracked trips

#: Every look at every trip: lists of its stops' times as planned and with actual times, and a step of recursion for each look.
_LOOKS = f""", i AS (SELECT f.fahrtnummer, f.betriebstag, f.produkt, linienname, richtung, vgnkennung, epoch_ms(ankunft_soll) AS an, epoch_ms(abfahrt_soll) AS ab,
    epoch_ms(ankunft_soll) + ankunft_v::BIGINT * 1000 AS an_ist, epoch_ms(abfahrt_soll) + abfahrt_v::BIGINT * 1000 AS ab_ist,
    row_number() OVER (PARTITION BY f.betriebstag, f.fahrtnummer, f.produkt ORDER BY coalesce(ankunft_soll, abfahrt_soll) NULLS LAST, vgnkennung) AS idx
    FROM fahrten_halte f JOIN fahrten g USING (fahrtnummer, betriebstag, produkt) WHERE f.betriebstag {DAYS}),
v AS (SELECT i.*, noon, CASE WHEN noon THEN an_ist END AS ai, CASE WHEN noon THEN ab_ist END AS bi FROM i, (SELECT unnest([false, true]) AS noon)),
w AS (SELECT *, coalesce(ai, an, bi, ab) AS arrival, lead(ai) OVER x AS n_ai, lead(an) OVER x AS n_an, lead(coalesce(ai, bi, an, ab)) OVER x AS due,
    coalesce(bi, ab) - greatest(coalesce(lead(an) OVER x - lead(ai) OVER x, 0), 0) AS l, coalesce(ai, an) AS c
    FROM v WINDOW x AS (PARTITION BY betriebstag, fahrtnummer, produkt, noon ORDER BY idx)),
trips AS (SELECT betriebstag, fahrtnummer, produkt, epoch_ms(betriebstag::TIMESTAMP) AS day_ms, count(*) FILTER (WHERE NOT noon) AS n,
    list(vgnkennung ORDER BY idx) FILTER (WHERE NOT noon) AS vgn, list(arrival ORDER BY idx) FILTER (WHERE NOT noon) AS a0, list(arrival ORDER BY idx) FILTER (WHERE noon) AS a1,
    list(CASE WHEN l IS NULL THEN c WHEN c IS NULL THEN l ELSE greatest(l, c) END ORDER BY idx) FILTER (WHERE NOT noon) AS s0,
    list(CASE WHEN l IS NULL THEN c WHEN c IS NULL THEN l ELSE greatest(l, c) END ORDER BY idx) FILTER (WHERE noon) AS s1,
    list(due ORDER BY idx) FILTER (WHERE NOT noon) AS d0, list(due ORDER BY idx) FILTER (WHERE noon) AS d1,
    coalesce(arg_min(coalesce(ab, an), idx), 0) AS begins FROM w GROUP BY 1, 2, 3),
r AS (SELECT betriebstag, fahrtnummer, produkt, day_ms, n, vgn, a0, a1, s0, s1, d0, d1, greatest(begins, day_ms) AS now FROM trips
    UNION ALL
    SELECT betriebstag, fahrtnummer, produkt, day_ms, n, vgn, a0, a1, s0, s1, d0, d1, {{next}} FROM ({{look}}) WHERE k < n),
l AS (SELECT *, CASE WHEN k < n THEN {{next}} END AS next_run FROM ({{look}}))
SELECT betriebstag, fahrtnummer, produkt, 'stop' AS kind, min(now) AS at_ms, vgn[j]::INTEGER AS vgnkennung, NULL::INTEGER AS next_vgnkennung, NULL::BIGINT AS next_run
FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM l) WHERE aa[j] <= now GROUP BY 1, 2, 3, 6
UNION ALL
SELECT betriebstag, fahrtnummer, produkt, CASE WHEN k < n THEN 'live' ELSE 'finished' END, now, vgn[k]::INTEGER, CASE WHEN k < n THEN vgn[k + 1] END::INTEGER, next_run FROM l
"""
_LOOK = """SELECT *, coalesce(list_max([j FOR j IN range(1, n + 1) IF aa[j] <= now]), 1) AS k
    FROM (SELECT *, CASE WHEN noon THEN a1 ELSE a0 END AS aa, CASE WHEN noon THEN s1 ELSE s0 END AS ss, CASE WHEN noon THEN d1 ELSE d0 END AS dd FROM (SELECT *, now >= day_ms + 43200000 AS noon FROM r))"""
_NEXT = "(CASE WHEN dd[k] > ss[k] AND ss[k] + (dd[k] - ss[k]) / 2e0 > now THEN ceil(ss[k] + (dd[k] - ss[k]) / 2e0) WHEN dd[k] > now THEN dd[k] WHEN dd[k] IS NOT NULL THEN now + 30000 ELSE now + 300000 END)::BIGINT"


@query("stream_tracked_trips", _LOOKS.format(look=_LOOK, next=_NEXT), recursive=True)
def stream_tracked_trips(t: Fixtures):
    """The log of all trips of a month: each stop once, when it is reached; each look; each end."""
    folder = shared_folder(t.spark, "upstream")
    log = sinks.Table(shared_folder(t.spark, "table"), tracking.LOG)
    for some in halves(t.trip_answers(FROM, TO)):
        upstream.keep(some, folder, "trip")
        stream = feeds.itineraries(upstream.reader(t.spark, folder, "trip", stream=True))
        read_up(tracking.tracked(stream), log.sink("log"), f"{folder}/checkpoint", "update")
    return log.rows(t.spark).where("fahrtnummer > 0").select("betriebstag", "fahrtnummer", "produkt", "kind", "at_ms", "vgnkennung", "next_vgnkennung", "next_run")


# ---------------------------------------------------------------- seen until it ends

_SEEN = f""", sp AS (SELECT fahrzeugnummer, f.fahrtnummer, min(epoch_ms(coalesce(ankunft_soll, abfahrt_soll))) AS at_ms, max(epoch_ms(coalesce(ankunft_soll, abfahrt_soll))) + {tracking.KEEP_MS} AS expires_ms
    FROM fahrten_halte f JOIN fahrten g USING (fahrtnummer, betriebstag, produkt) WHERE f.betriebstag {DAYS} GROUP BY 1, 2),
nr AS (SELECT *, row_number() OVER (PARTITION BY fahrzeugnummer ORDER BY at_ms, expires_ms) AS i FROM sp),
fo AS (SELECT fahrzeugnummer, i, at_ms, expires_ms, true AS passed, expires_ms AS until FROM nr WHERE i = 1
    UNION ALL SELECT n.fahrzeugnummer, n.i, n.at_ms, n.expires_ms, n.at_ms >= until, CASE WHEN n.at_ms >= until THEN n.expires_ms ELSE until END FROM fo JOIN nr n ON n.fahrzeugnummer = fo.fahrzeugnummer AND n.i = fo.i + 1)
SELECT fahrzeugnummer, at_ms, expires_ms FROM fo WHERE passed"""


@query("stream_seen_until_end", _SEEN, recursive=True)
def stream_seen_until_end(t: Fixtures):
    """Vehicles as they are met on trips: one that is known counts again only an hour after the end of the trip that it was met on."""
    time = F.unix_millis(F.coalesce("ankunft_soll", "abfahrt_soll").cast("timestamp"))
    days = F.col("betriebstag").between(F.lit(FROM).cast("date"), F.lit(TO).cast("date"))
    spans = t.stop_events.where(days).groupBy("fahrtnummer", "betriebstag", "produkt").agg(F.min(time).alias("at_ms"), (F.max(time) + tracking.KEEP_MS).alias("expires_ms"))
    met = spans.join(t.trips.where(days).select("fahrtnummer", "betriebstag", "produkt", F.col("fahrzeugnummer").alias("key")), ["fahrtnummer", "betriebstag", "produkt"])
    folder = shared_folder(t.spark, "seen")
    met.select("key", "at_ms", "expires_ms").write.parquet(f"{folder}/rows")
    table = sinks.Table(f"{folder}/passed", "key int, at_ms bigint, expires_ms bigint")
    read_up(tracking.first_until(t.spark.readStream.schema(table.schema).parquet(f"{folder}/rows")), table.sink("seen"), f"{folder}/checkpoint", "update")
    return table.rows(t.spark).select(F.col("key").alias("fahrzeugnummer"), "at_ms", "expires_ms")
