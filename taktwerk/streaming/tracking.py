"""Trips tracked by keyed state and timers: each stop is recorded once, when it is reached, until a trip ends.

The clock is the watermark of the polls. A trip's timer fires at its next look; what is evaluated then is the answer
that was known at that moment, so the log does not depend on how polls fall into batches. State of a trip: its next
look (value), its answers that still count (list), its recorded stops (list). A trip that ends, fails or expires loses
all three, and the last row of its log says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("betriebstag", "fahrtnummer", "produkt")
LOG = "betriebstag date, fahrtnummer int, produkt tinyint, kind string, at_ms bigint, idx int, vgnkennung int, next_vgnkennung int, linienname string, richtung tinyint, progress double, next_run bigint, expires_ms bigint"
STOPS = "array<struct<vgnkennung:int,an_soll:bigint,an_ist:bigint,ab_soll:bigint,ab_ist:bigint>>"
#: A trip's state is kept so long after its last stop; tries and waits of a trip whose answers hold nothing.
KEEP_MS, TRIES, WAIT_MS = 3_600_000, 5, 1000
#: The next look: where the next stop's time has passed, and where it has none.
SOON_MS, LATER_MS = 30_000, 300_000


TIMES = ("vgnkennung", "an_soll", "an_ist", "ab_soll", "ab_ist")


def plain(stops: list | None) -> list[tuple]:
    """Stops as tuples in the order of ``TIMES``, as states hold them."""
    return [tuple(s[c] for c in TIMES) for s in stops or ()]


def named(stops: list | None) -> list[dict]:
    return [dict(zip(TIMES, s)) for s in stops or ()]


def first(*times: int | None) -> int | None:
    return next((t for t in times if t is not None and t != -1), None)


class Look(NamedTuple):
    """A trip at a moment: the furthest stop, all that were reached, progress to the next one, when to look again."""

    idx: int
    reached: list[int]
    progress: float
    next_run: int | None
    ends: int | None


def look(stops: list[Any], now: int) -> Look:
    """Evaluates an itinerary; the times of a stop count in the order actual and planned arrival, then departure."""
    arrivals = [first(s["an_ist"], s["an_soll"], s["ab_ist"], s["ab_soll"]) for s in stops]
    reached = [i for i, a in enumerate(arrivals) if a is not None and a <= now]
    idx, ends = (reached[-1] if reached else 0), max((a for a in arrivals if a is not None), default=None)
    if idx == len(stops) - 1:
        return Look(idx, reached, 0.0, None, ends)
    here, then = stops[idx], stops[idx + 1]
    left, came = first(here["ab_ist"], here["ab_soll"]), first(here["an_ist"], here["an_soll"])
    planned, actual = first(then["an_soll"]), first(then["an_ist"])
    if left is not None and planned is not None and actual is not None:
        left -= max(planned - actual, 0)
    start = came if left is None else left if came is None else max(left, came)
    arrival, due = arrivals[idx + 1], first(then["an_ist"], then["ab_ist"], then["an_soll"], then["ab_soll"])
    share = 0.0 if start is None or arrival is None or arrival <= start else min(1.0, max(0.0, (now - start) / (arrival - start)))
    half = (start + due) / 2 if start is not None and due is not None and due > start else None
    again = math.ceil(half) if half is not None and half > now else due if due is not None and due > now else now + (LATER_MS if due is None else SOON_MS)
    return Look(idx, reached, share, again, ends)


class Tracker(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trip = handle.getValueState("trip", "next_run bigint, tries int")
        self.answers = handle.getListState("answers", f"poll bigint, linienname string, richtung tinyint, stops {STOPS}")
        self.recorded = handle.getListState("recorded", "vgnkennung int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = sorted(((r["poll"], r["linienname"], r["richtung"], plain(r["stops"])) for r in rows), key=lambda r: r[0])
        if not self.trip.exists():
            poll, stops = came[0][0], named(came[0][3])
            begins = first(*(stops[0][c] for c in ("ab_ist", "ab_soll", "an_ist", "an_soll"))) if stops else poll
            ends = first(*(stops[-1][c] for c in ("an_ist", "an_soll", "ab_ist", "ab_soll"))) if stops else poll + 1
            if begins is None or ends is None or ends <= poll:
                yield self._row(key, "invalid", poll, came[0])
                return
            self._schedule(max(begins, poll), 0)
        self.answers.appendList(came)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.trip.exists():
            return
        now, tries = self.trip.get()
        until = timerValues.getCurrentWatermarkInMs()
        answers, recorded, new = sorted(((a[0], a[1], a[2], named(a[3])) for a in self.answers.get()), key=lambda a: a[0]), {r[0] for r in self.recorded.get()}, []
        while now <= until:
            known = [a for a in answers if a[0] <= now]
            answers = [*known[-1:], *answers[len(known) :]]
            answer = known[-1] if known else (now, None, None, None)
            stops = answer[3]
            if not stops:
                tries += 1
                if tries == TRIES:
                    yield from self._over(key, "failed", now, answer)
                    return
                now += WAIT_MS << (tries - 1)
                continue
            seen, tries = look(stops, now), 0
            for i in seen.reached:
                if stops[i]["vgnkennung"] not in recorded:
                    recorded.add(stops[i]["vgnkennung"])
                    new.append((stops[i]["vgnkennung"],))
                    yield self._row(key, "stop", now, answer, i)
            expires = None if seen.ends is None else seen.ends + KEEP_MS
            if seen.next_run is None or (expires is not None and now >= expires):
                yield from self._over(key, "finished" if seen.next_run is None else "expired", now, answer, seen.idx)
                return
            yield self._row(key, "live", now, answer, seen.idx, seen, expires)
            now = seen.next_run
        if new:
            self.recorded.appendList(new)
        self.answers.put([(a[0], a[1], a[2], plain(a[3])) for a in answers])
        self._schedule(now, tries)

    def _schedule(self, at: int, tries: int) -> None:
        self.trip.update((at, tries))
        self.handle.registerTimer(at)

    def _over(self, key: Any, kind: str, now: int, answer: tuple, idx: int | None = None) -> Iterator[Row]:
        for state in (self.trip, self.answers, self.recorded):
            state.clear()
        yield self._row(key, kind, now, answer, idx)

    @staticmethod
    def _row(key: Any, kind: str, now: int, answer: tuple, idx: int | None = None, seen: Look | None = None, expires: int | None = None) -> Row:
        stops = answer[3]
        here = None if idx is None else stops[idx]["vgnkennung"]
        then = None if seen is None else stops[idx + 1]["vgnkennung"]
        return Row(betriebstag=key[0], fahrtnummer=key[1], produkt=key[2], kind=kind, at_ms=now, idx=idx, vgnkennung=here, next_vgnkennung=then, linienname=answer[1], richtung=answer[2], progress=None if seen is None else seen.progress, next_run=None if seen is None else seen.next_run, expires_ms=expires)


def tracked(itineraries: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The log of all trips of a stream of answers (see ``feeds.itineraries``): stop, live, and at last finished, failed, expired or invalid.

    Polls may come late by ``late``; the session's state store must be RocksDB, which timers and lists need.
    """
    rows = itineraries.withColumn("event_time", F.timestamp_millis("poll")).withWatermark("event_time", late)
    return rows.groupBy(*KEY).transformWithState(Tracker(), LOG, "update", "eventTime")


def live(log: DataFrame) -> DataFrame:
    """The trips under way by a log: the last look of each that has not ended."""
    last = log.where("kind <> 'stop'").groupBy(*KEY).agg(F.max_by(F.struct("kind", "idx", "vgnkennung", "next_vgnkennung", "linienname", "richtung", "progress", "next_run", "expires_ms"), F.struct("at_ms", (F.col("kind") != "live").alias("over"))).alias("s"))
    return last.where("s.kind = 'live'").select(*KEY, "s.*").drop("kind")


def index_rows(trips: DataFrame) -> DataFrame:
    """The index of live trips by line, direction and next stop, with when an entry expires."""
    return trips.where("linienname is not null and richtung is not null and next_vgnkennung is not null").select("linienname", "richtung", "next_vgnkennung", *KEY, "expires_ms")


class Until(StatefulProcessor):
    """Passes a row of a key if the last one that passed has expired by then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        until = self.expires.get()[0] if self.expires.exists() else None
        for at, expires in sorted((r["at_ms"], r["expires_ms"]) for r in rows):
            if until is None or at >= until:
                until = expires
                yield Row(key=key[0], at_ms=at, expires_ms=expires)
        self.expires.update((until,))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.expires.exists() and self.expires.get()[0] <= timerValues.getCurrentWatermarkInMs():
            self.expires.clear()  # what comes from now on is later
        return iter([])


def first_until(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Of ``rows(key, at_ms, expires_ms)`` the first of each key, and none more before that one's own expiry; then the next.

    What counts is the time of a row, not when it is read; a state goes once the watermark has passed its expiry.
    """
    timed = rows.where("key is not null and at_ms is not null and expires_ms is not null").withColumn("event_time", F.timestamp_millis("at_ms")).withWatermark("event_time", late)
    kind = dict(rows.dtypes)["key"]
    return timed.groupBy("key").transformWithState(Until(), f"key {kind}, at_ms bigint, expires_ms bigint", "update", "eventTime")
