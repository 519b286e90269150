"""Trips under way: which stops are reached, what is still to record, when to look again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions import timing
from taktwerk.sources.schema import TRIP_KEY


def itineraries(events: DataFrame) -> DataFrame:
    """Stop events with their place in the trip and times in milliseconds: planned and actual arrival and departure."""
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    order = Window.partitionBy(*TRIP_KEY).orderBy(F.coalesce("ankunft_soll", "abfahrt_soll").asc_nulls_last(), "vgnkennung")
    rows = events.withColumns({"an_soll": millis("ankunft_soll"), "ab_soll": millis("abfahrt_soll"), "idx": (F.row_number().over(order) - 1).cast("int")})
    return rows.withColumns({"an_ist": F.col("an_soll") + F.col("ankunft_v") * 1000, "ab_ist": F.col("ab_soll") + F.col("abfahrt_v") * 1000})


def at(rows: DataFrame, now: Column) -> DataFrame:
    """A row for each trip: the furthest stop reached by ``now`` (0 if none), the next, progress and the next look.

    ``rows`` are itineraries. One window over a trip finds the successor of each stop, one aggregation the furthest.
    """
    arrival = timing.arrival_time(F.col("an_ist"), F.col("an_soll"), F.col("ab_ist"), F.col("ab_soll"))
    w = Window.partitionBy(*TRIP_KEY).orderBy("idx")
    following = {f"next_{c}": F.lead(c).over(w) for c in ("vgnkennung", "an_ist", "an_soll", "ab_ist", "ab_soll")}
    rows = rows.withColumns(following | {"arrival": arrival})
    reached = (F.col("arrival") <= now) | (F.col("idx") == 0)
    state = F.struct("idx", "vgnkennung", "an_ist", "an_soll", "ab_ist", "ab_soll", *following)
    out = rows.groupBy(*TRIP_KEY).agg(
        F.max_by(state, F.when(reached, F.col("idx"))).alias("s"), F.max("idx").alias("last_idx"),
        F.array_sort(F.collect_list(F.when(F.col("arrival") <= now, F.struct("idx", "vgnkennung")))).alias("reached"),
        F.min("arrival").alias("starts"), F.max("arrival").alias("ends"),
    ).select(*TRIP_KEY, "s.*", "last_idx", F.transform("reached", lambda x: x["vgnkennung"]).alias("reached"), "starts", "ends")
    start = timing.segment_start(F.col("an_ist"), F.col("an_soll"), F.col("ab_ist"), F.col("ab_soll"), F.col("next_an_ist"), F.col("next_an_soll"))
    next_arrival = timing.arrival_time(F.col("next_an_ist"), F.col("next_an_soll"), F.col("next_ab_ist"), F.col("next_ab_soll"))
    following_stop = timing.first_time(F.col("next_an_ist"), F.col("next_ab_ist"), F.col("next_an_soll"), F.col("next_ab_soll"))
    finished = F.col("idx") == F.col("last_idx")
    share = timing.progress(now, start, next_arrival, F.lit(0.0))
    return out.withColumns({"finished": finished, "progress": F.when(finished, F.lit(0.0)).otherwise(share), "next_run": F.when(~finished, timing.next_run(now, start, following_stop))})


def pending(reached: Column, recorded: Column) -> Column:
    """What of ``reached`` is not recorded yet, in order and with its repeats."""
    return F.filter(reached, lambda x: ~F.array_contains(recorded, x))


def untracked(trips: DataFrame, tracked: DataFrame) -> DataFrame:
    """Trips that nobody tracks."""
    return trips.join(tracked.select("fahrtnummer").distinct(), "fahrtnummer", "left_anti")
