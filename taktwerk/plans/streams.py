"""Streaming queries, run over the fixtures until they have read all there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktwerk.plans.operations import LIMITER
from taktwerk.plans.registry import query
from taktwerk.sources.fixtures import Fixtures
from taktwerk.streaming import queries as op
from taktwerk.sources.scratch import shared_folder
from taktwerk.streaming import sinks
from taktwerk.streaming.run import drained, read_up, table_stream


def events(t: Fixtures):
    return table_stream(t.spark, t.sf_dir, "events")


@query("stream_dedup_trips", "SELECT DISTINCT user_id FROM events", prelude=False)
def stream_dedup_trips(t: Fixtures):
    return drained(op.first_seen(events(t), "user_id", "ts", "40 days").select("user_id"))


@query("stream_metric_window", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2", prelude=False)
def stream_metric_window(t: Fixtures):
    out = drained(op.windowed_points(events(t), "event_type", "ts", "value", "1 day"), "complete")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("mean", 6).alias("mean"))


@query("stream_trip_state", "SELECT user_id AS id, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'finished' WHEN count(*) > 1 THEN 'tracked' ELSE 'created' END AS phase, count(*) AS n FROM events GROUP BY 1", prelude=False)
def stream_trip_state(t: Fixtures):
    """The states that one pass over the table leaves, before any key has been idle too long."""
    out = drained(op.tracked(events(t), "user_id", "ts", "event_type = 'purchase'", idle_ms=90 * 86_400_000), "update")
    return out.where("phase <> 'failed'").groupBy("id").agg(F.max_by("phase", "n").alias("phase"), F.max("n").alias("n"))


@query("stream_rate_limiter", LIMITER.format("n.drained") + " SELECT user_id AS id, count(*) FILTER (WHERE NOT blocked) AS passed, count(*) FILTER (WHERE blocked) AS blocked FROM l GROUP BY 1", prelude=False)
def stream_rate_limiter(t: Fixtures):
    return drained(op.limited(events(t), "user_id", "ts"), "update").groupBy("id").agg(F.max("passed").alias("passed"), F.max("blocked").alias("blocked"))


#: Views are requests, and the event right after one is its response if it is none itself and comes within the hour.
_PAIRED = """SELECT a.event_id AS request_id, a.ts AS requested_at, epoch_us(b.ts) - epoch_us(a.ts) AS duration_us FROM events a
LEFT JOIN (SELECT event_id - 1 AS event_id, ts FROM events WHERE event_type <> 'view') b ON a.event_id = b.event_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'view' AND (b.ts IS NOT NULL OR a.ts + INTERVAL 1 HOUR < (SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type <> 'view')) - INTERVAL 1 HOUR FROM events))"""


@query("stream_paired_calls", _PAIRED, prelude=False)
def stream_paired_calls(t: Fixtures):
    """Requests with their responses; without one they are timeouts, but for those of the last hours, which may still be answered."""
    requests = events(t).where("event_type = 'view'").select(F.col("event_id").alias("request_id"), "ts")
    responses = events(t).where("event_type <> 'view'").select((F.col("event_id") - 1).alias("request_id"), "ts")
    table = sinks.Table(shared_folder(t.spark, "table"), "request_id bigint, requested_at timestamp, duration_us bigint")
    read_up(op.paired(requests, responses, "1 hour"), table.sink("trace"), shared_folder(t.spark, "checkpoint"))
    return table.rows(t.spark).select("request_id", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"), "duration_us")
