"""Jobs that ask a stop for a trip shortly before it leaves, and the paced resolution of trips that boards name.

What a job finds depends on its own stop and the next alone, and it exists if all jobs before it scheduled the one
that follows. So a trip's chain of jobs is one ordered window over its stops: successors by ``lead``, existence by a
running minimum. A trip has few stops; trips are dealt by their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.sources.schema import TRIP_KEY

#: A job is due so long before its departure; one that would start sooner than this is not scheduled;
#: how far ahead the board of the stop and, on a second try, of the next stop is read.
LEAD_MS, LEAST_DELAY_MS = 30_000, 10_000
SPAN_MS, NEXT_SPAN_MS = 5 * 60_000, 20 * 60_000


def late_jobs(stops: DataFrame, key: Sequence[str] = TRIP_KEY, lead_ms: int = LEAD_MS, least_delay_ms: int = LEAST_DELAY_MS) -> DataFrame:
    """(key, idx, attempts, outcome, next_delay_ms, follows): a row for each job that ran.

    ``stops`` has for each stop of a trip: its place ``idx`` from 0, the ``planned`` and ``actual`` departure in
    milliseconds, ``wait_ms`` from when a job is due until a worker has it, and ``request_ms`` that the board takes.
    Outcomes: ``found``; ``late`` (begun more than the lead after it was due: on to the next stop); ``slow`` (not found,
    the answer took the lead: on to the next stop); ``ahead`` (not found twice, but the next stop lists it); ``lost``
    (nor there); ``finished`` (nothing left to ask). ``follows`` is ``scheduled``, ``dropped`` (the next job
    would start too soon, or its time is unknown), ``kept`` after ``ahead``, or ``ended``. A trip whose first time is
    unknown has no jobs; an unknown wait or request counts as 0, an unknown actual departure is on no board.
    """
    trip = Window.partitionBy(*key).orderBy("idx")
    c, lead = F.col, F.lit(lead_ms)
    rows = stops.select(*key, "idx", "planned", "actual", F.coalesce("wait_ms", F.lit(0)).alias("wait_ms"), F.coalesce("request_ms", F.lit(0)).alias("request_ms"))
    rows = rows.withColumns({
        "next_planned": F.lead("planned").over(trip), "next_actual": F.lead("actual").over(trip),
        "is_last": F.lead("idx").over(trip).isNull(), "near_end": F.lead("idx", 2).over(trip).isNull(),
    })
    listed = lambda dep, at, span: F.coalesce(dep.between(at, at + span), F.lit(False))
    rows = rows.withColumn("first_at", c("planned") - lead + c("wait_ms")).withColumn("second_at", c("first_at") + c("request_ms"))
    late = lambda at: at - (c("planned") - lead) > lead
    gone_by = F.when(c("near_end"), "finished").otherwise("late")
    second = F.when(late(c("second_at")), gone_by).when(listed(c("actual"), c("second_at"), SPAN_MS), "found").when(c("near_end"), "finished")
    second = second.when(listed(c("next_actual"), c("second_at") + c("request_ms"), NEXT_SPAN_MS), "ahead").otherwise("lost")
    first = F.when(late(c("first_at")), gone_by).when(listed(c("actual"), c("first_at"), SPAN_MS), "found").when(c("request_ms") >= lead, "slow").when(c("is_last"), "finished")
    rows = rows.withColumn("first", first).withColumn("attempts", F.when(c("first").isNull(), 2).otherwise(1)).withColumn("outcome", F.coalesce("first", second))
    begun = F.when(c("attempts") == 2, c("second_at")).otherwise(c("first_at"))
    # after an answer the clock stands a request later, and the next request is begun earlier by as much
    spent = F.when(c("outcome") == "late", 0).otherwise(2 * c("request_ms"))
    delay = F.when(c("outcome").isin("found", "late", "slow") & ~c("is_last"), c("next_planned") - lead - begun - spent)
    rows = rows.withColumn("delay", delay)
    follows = F.when(c("outcome") == "ahead", "kept").when(c("outcome").isin("lost", "finished") | c("is_last"), "ended")
    rows = rows.withColumn("follows", follows.when(c("delay") >= least_delay_ms, "scheduled").otherwise("dropped"))
    alive = F.min(F.when(c("follows") == "scheduled", 1).otherwise(0)).over(trip.rowsBetween(Window.unboundedPreceding, -1))
    start_known = F.first("planned").over(trip).isNotNull()
    rows = rows.withColumn("ran", F.coalesce(alive == 1, F.lit(True)) & start_known).where("ran")
    return rows.select(*key, "idx", "attempts", "outcome", F.when(c("follows") == "scheduled", c("delay")).alias("next_delay_ms"), "follows")


def lane_of(key: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


def paced(queue: DataFrame, lane: str, arrived_ms: str, order: str, every_ms: int) -> DataFrame:
    """``queue`` with ``starts_ms``: each lane starts its rows by arrival, ties by ``order``, ``every_ms`` or more apart.

    A start is the later of the arrival and the last start plus the pause, which unrolled is a running maximum: the
    n-th starts at n pauses after the latest of (arrival - place * pause) so far. A budget that many workers share
    is dealt by lanes, each pausing as many times longer; no row is lost, none starts before it came.
    """
    w = Window.partitionBy(lane).orderBy(arrived_ms, order)
    rows = queue.withColumn("ahead_", (F.row_number().over(w) - 1) * F.lit(every_ms))
    latest = F.max(F.col(arrived_ms) - F.col("ahead_")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("starts_ms", latest + F.col("ahead_")).drop("ahead_")
