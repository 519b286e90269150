"""Late jobs and paced resolution against loops."""

import random

import pytest
from pyspark.sql import functions as F

from taktwerk.operators import jobs

SCHEMA = "trip int, idx int, planned long, actual long, wait_ms long, request_ms long"


def worker(stops):
    """A trip's jobs one by one, as a worker meets them."""
    done, i, last = [], 0, len(stops) - 1
    if stops[0][0] is None:
        return done
    while True:
        planned, actual, wait, request = stops[i]
        wait, request = wait or 0, request or 0
        now, attempt = planned - 30_000 + wait, 1
        while True:
            listed = actual is not None and now <= actual <= now + 300_000
            if now - (planned - 30_000) > 30_000:
                outcome, delay_from = ("finished", None) if i + 1 >= last else ("late", now)
            elif listed:
                outcome, delay_from = "found", now + 2 * request
            elif attempt == 1 and request >= 30_000:
                outcome, delay_from = "slow", now + 2 * request
            elif i == last or attempt == 2 and i + 1 >= last:
                outcome, delay_from = "finished", None
            elif attempt == 1:
                attempt, now = 2, now + request
                continue
            else:
                following, asked = stops[i + 1][1], now + request
                outcome, delay_from = ("ahead" if following is not None and asked <= following <= asked + 1_200_000 else "lost"), None
            break
        if outcome == "ahead":
            done.append((i, attempt, outcome, None, "kept"))
            return done
        if delay_from is None or i == last:
            done.append((i, attempt, outcome, None, "ended"))
            return done
        following = stops[i + 1][0]
        if following is None or following - 30_000 - delay_from < 10_000:
            done.append((i, attempt, outcome, None, "dropped"))
            return done
        done.append((i, attempt, outcome, following - 30_000 - delay_from, "scheduled"))
        i += 1


def test_late_jobs_against_a_worker(spark):
    rng = random.Random(5)
    trips = {}
    for trip in range(600):
        at, stops = 1_000_000, []
        for _ in range(rng.randint(1, 9)):
            at += rng.choice([45_000, 60_000, 180_000])
            planned = None if rng.random() < 0.02 else at
            actual = None if rng.random() < 0.1 else at + rng.choice([-60_000, 0, 30_000, 120_000, 400_000])
            stops.append((planned, actual, rng.choice([None, 0, 0, 5_000, 29_990, 30_001, 100_000]), rng.choice([None, 20, 900, 900, 31_000])))
        trips[trip] = stops
    rows = [(k, i, *s) for k, stops in trips.items() for i, s in enumerate(stops)]
    got = {}
    for r in jobs.late_jobs(spark.createDataFrame(rows, SCHEMA).repartition(5), ["trip"]).orderBy("trip", "idx").collect():
        got.setdefault(r.trip, []).append((r.idx, r.attempts, r.outcome, r.next_delay_ms, r.follows))
    assert got == {k: w for k, stops in trips.items() if (w := worker(stops))}
    assert {o for w in got.values() for _, _, o, _, _ in w} == {"found", "late", "slow", "ahead", "lost", "finished"}
    assert {f for w in got.values() for *_, f in w} == {"scheduled", "dropped", "kept", "ended"}


def test_no_jobs_of_no_trips(spark):
    assert jobs.late_jobs(spark.createDataFrame([], SCHEMA), ["trip"]).count() == 0


@pytest.mark.parametrize("lanes", [1, 3])
def test_paced_keeps_to_the_budget_and_loses_none(spark, lanes):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 0, 0, 10_000, 10_500, 60_000, rng.randint(0, 80_000)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, at long").withColumn("lane", jobs.lane_of(F.col("id"), lanes))
    got = jobs.paced(df, "lane", "at", "id", 250 * lanes).collect()
    assert sorted(r.id for r in got) == list(range(200))
    by_lane = {}
    for r in sorted(got, key=lambda r: (r.lane, r.at, r.id)):
        last = by_lane.get(r.lane)
        assert r.starts_ms == (r.at if last is None else max(r.at, last + 250 * lanes))
        by_lane[r.lane] = r.starts_ms
    starts = sorted(r.starts_ms for r in got)
    assert all(sum(s <= x < s + 1000 for x in starts) <= 4 + lanes for s in starts)
