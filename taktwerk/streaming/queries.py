"""Stateful streaming operators: deduplication, windows, tracked trips, limits and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(events: DataFrame, key: str, ts: str, keep_for: str) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it by ``keep_for``."""
    return events.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", keep_for).dropDuplicatesWithinWatermark([key])


def windowed_points(events: DataFrame, key: str, ts: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    """Number and mean of points by key and tumbling window of event time."""
    rows = events.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)
    out = rows.groupBy(key, F.window("event_time", width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(key, F.col("window.start").alias("window_start"), "n", "mean")


TRACKED = "id bigint, phase string, n bigint, last_ms bigint"


def tracked(events: DataFrame, key: str, ts: str, finished: str, idle_ms: int = 3_600_000) -> DataFrame:
    """A state machine for each key: created, tracked while points come, finished by a point of the kind ``finished``
    or failed after ``idle_ms`` of event time without one. Every batch emits a row for each key that changed."""
    state = "n bigint, last_ms bigint"

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            n, last = held.get
            held.remove()
            yield pd.DataFrame({"id": [k[0]], "phase": ["failed"], "n": [n], "last_ms": [last]})
            return
        n, last = held.get if held.exists else (0, 0)
        done = False
        for batch in batches:  # a key's rows may come in several chunks
            n, last, done = n + len(batch), max(last, int(batch["ms"].max())), done or bool(batch["done"].any())
        phase = "finished" if done else "tracked" if n > 1 else "created"
        if phase == "finished":
            if held.exists:
                held.remove()
        else:
            held.update((n, last))
            held.setTimeoutTimestamp(max(last + idle_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [k[0]], "phase": [phase], "n": [n], "last_ms": [last]})

    rows = events.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", "1 hour").select(F.col(key).cast("bigint").alias("id"), F.unix_millis("event_time").alias("ms"), F.expr(finished).alias("done"), "event_time")
    return rows.groupBy("id").applyInPandasWithState(step, TRACKED, state, "update", GroupStateTimeout.EventTimeTimeout)


def limited(events: DataFrame, key: str, ts: str, a_minute: float = 10.0) -> DataFrame:
    """Passed and blocked calls of each key by a leaky counter; the level and its time are the state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        level, last, passed, blocked = held.get if held.exists else (None, 0, 0, 0)
        for ms in sorted(m for batch in batches for m in batch["ms"]):
            ms = max(int(ms), last)  # a late call counts as one of now: it drains nothing
            drained = None if level is None else level - (ms - last) / 60_000 * a_minute
            stop = drained is not None and drained + 1 >= a_minute
            level, last = (1.0 if drained is None else max(0.0, drained) + (0.0 if stop else 1.0)), ms
            passed, blocked = passed + (not stop), blocked + stop
        held.update((level, last, passed, blocked))
        yield pd.DataFrame({"id": [k[0]], "passed": [passed], "blocked": [blocked]})

    rows = events.select(F.col(key).cast("bigint").alias("id"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return rows.groupBy("id").applyInPandasWithState(step, "id bigint, passed bigint, blocked bigint", "level double, last bigint, passed bigint, blocked bigint", "update", GroupStateTimeout.NoTimeout)


def snapshots(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Pushes the state of a stream on a clock; a batch that takes longer delays the next, they never overlap."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(processingTime=every).start()


def paired(requests: DataFrame, responses: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Calls of a trace: (request_id, requested_at, duration_us), from requests and responses (request_id, ts).

    A response counts within ``within`` of its request; a request without one comes out as a timeout, without a
    duration, once the watermarks of both sides have passed that bound, and both sides' states go with it.
    """
    asked = requests.select("request_id", F.col("ts").cast("timestamp").alias("requested_at")).withWatermark("requested_at", late)
    told = responses.select(F.col("request_id").alias("answered_id"), F.col("ts").cast("timestamp").alias("answered_at")).withWatermark("answered_at", late)
    bound = (F.col("request_id") == F.col("answered_id")) & (F.col("answered_at") >= F.col("requested_at")) & (F.col("answered_at") <= F.col("requested_at") + F.expr(f"interval {within}"))
    return asked.join(told, bound, "left_outer").select("request_id", "requested_at", (F.unix_micros("answered_at") - F.unix_micros("requested_at")).alias("duration_us"))
