"""Operators on small tables made by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from taktwerk.operators import discovery, geometry, operations, stops, trips
from taktwerk.operators.versioned import latest_version


def test_latest_version_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (2, 1, "d")], "k int, v int, x string")
    once = latest_version(df, ["k"], "v")
    assert sorted(tuple(r) for r in once.collect()) == [(1, 2, "b"), (2, 1, "d")]
    assert sorted(tuple(r) for r in latest_version(once.unionByName(df), ["k"], "v").collect()) == [(1, 2, "b"), (2, 1, "d")]


def test_pending_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([([3, 1, 3, 2], [1]), ([], [1]), ([1], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(trips.pending(F.col("a"), F.col("b"))).collect()] == [[3, 3, 2], [], []]


def test_limiter_that_only_asks(spark):
    calls = [(1, 0, None), (1, 1, 4.0), (1, 2, 5.0), (1, 3, None), (1, 3, 2.0), (1, 60_003, None), (2, 0, 9.5), (2, 0, None), (2, 3_000, None), (3, 5, None), (3, 6, 1.0)]
    rows = operations.limited(spark.createDataFrame(calls, "k int, t long, cost double"), "k", "t", "cost").collect()
    got = {(r.k, r.t, r.cost): (None if r.level is None else round(r.level, 3), r.blocked, r.retry_ms) for r in rows}
    assert got == {
        (1, 0, None): (None, False, None), (1, 1, 4.0): (4.0, False, None), (1, 2, 5.0): (9.0, False, None), (1, 3, None): (9.0, False, None), (1, 3, 2.0): (9.0, True, -2), (1, 60_003, None): (0.0, False, None),
        (2, 0, None): (None, False, None), (2, 0, 9.5): (9.5, False, None), (2, 3_000, None): (9.0, True, 0), (3, 5, None): (None, False, None), (3, 6, 1.0): (1.0, False, None),
    }


def test_limiter_against_a_fold(spark):
    import random

    random.seed(3)
    calls = [(random.randint(1, 5), random.randint(0, 400_000), 1.0) for _ in range(400)]
    got = {(r.k, r.t): (round(r.level, 6), r.blocked) for r in operations.limited(spark.createDataFrame(calls, "k int, t long, cost double"), "k", "t", "cost").collect()}
    state = {}
    for k, t, c in sorted(calls):
        if k not in state:
            state[k] = (c, t)
            assert got[k, t] == (c, False)
            continue
        level, last = state[k]
        drained = level - (t - last) / 60_000 * 10
        blocked = drained + c >= 10
        state[k] = (max(0, drained) + (0 if blocked else c), t)
        assert got[k, t] == (round(state[k][0], 6), blocked)


def test_next_request_transitions(spark):
    rows = [(3, 5_000, 10, None), (3, 1, 10, "sparse"), (3, None, 10, None), (0, None, 10, None), (0, None, 10, "empty-retry"), (0, None, 60, None), (0, None, 10, "sparse"), (0, None, 10, "normal")]
    df = spark.createDataFrame(rows, "d int, l long, r int, p string")
    made = discovery.next_request(F.col("d"), F.col("l"), F.col("r"), F.col("p"), F.lit(2_000))
    got = [tuple(r) for r in df.select(*made.values()).collect()]
    m = 60_000
    assert got == [("normal", 10, 5_000), ("normal", 10, 3_000), ("normal", 10, 2_000 + 10 * m), ("empty-retry", 60, 2_000 + 10 * m), ("sparse", 60, 2_000 + 60 * m), ("sparse", 60, 2_000 + 60 * m), ("sparse", 60, 2_000 + 60 * m), ("empty-retry", 60, 2_000 + 10 * m)]


def test_seeds_count_up_over_blocks(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 2000, 3)], "vgnkennung int")
    got = [r.place for r in discovery.seeded(df, F.lit(0)).orderBy("vgnkennung").collect()]
    assert got == list(range(len(got)))


def test_map_matching(spark):
    points = spark.createDataFrame([("L", 0, 0, 0.0, 0.0), ("L", 0, 1, 0.0, 1.0), ("L", 0, 2, 0.0, 1.0), ("L", 0, 3, 1.0, 1.0), ("M", 0, 0, 0.0, 0.0), ("N", 0, 0, 0.0, 0.0), ("N", 0, 1, 99.0, 0.0)], "line string, route int, pos int, latitude double, longitude double")
    segs = geometry.segments(points)
    assert {r.line for r in segs.select("line").distinct().collect()} == {"L"}  # one point, or no coordinate: no geometry
    places = spark.createDataFrame([("L", 1, 0.2, 0.5), ("L", 2, 0.5, 2.0)], "line string, vgnkennung int, latitude double, longitude double")
    proj = geometry.projected(places, segs)
    trips_ = spark.createDataFrame([(7, "L", 1, 2, 0.5), (8, "M", 1, 2, 0.5)], "id long, line string, vgnkennung int, next_vgnkennung int, progress double")
    got = {r.id: (r.est_latitude, r.est_longitude) for r in geometry.estimated(trips_, proj, segs, F.col("progress")).collect()}
    assert got[8] == (None, None)
    assert got[7][0] == pytest.approx(0.0, abs=1e-3) and got[7][1] == pytest.approx(1.0, abs=1e-3)


def test_places_meet_the_segments_near_them(spark, monkeypatch):
    """Grids give what all pairs give: stops of the route, crossings, places off the route and outside its box, ties; with few pairs."""
    rng = random.Random(7)
    point = lambda: (49.3 + rng.randrange(1000) * 3e-4, 10.9 + rng.randrange(1000) * 4e-4)
    routes = {("L", 0): [point() for _ in range(1500)], ("L", 1): [point() for _ in range(5)], ("M", 0): [(49.4, 11.0), (49.4, 11.2), (49.4, 11.0)]}
    segs = geometry.segments(spark.createDataFrame([(*key, i, *p) for key, points in routes.items() for i, p in enumerate(points)], "line string, route int, pos int, latitude double, longitude double"))
    some = [*rng.sample(routes["L", 0], 60), *routes["L", 1], *(point() for _ in range(60)), (49.0, 10.0), (50.5, 11.0)]
    rows = [("L", i, *p) for i, p in enumerate(some)] + [("L", 1000, *some[0]), ("M", 1, 49.4, 11.1), ("M", 2, 49.4, 11.2), ("X", 3, 49.4, 11.1)]
    places = spark.createDataFrame(rows, "line string, vgnkennung int, latitude double, longitude double")
    scaled = places.withColumn("scale", geometry.plane_scale(F.col("latitude"))).join(segs.select("line", "route").distinct(), "line")
    order = lambda df: sorted(map(tuple, df.select("line", "route", "vgnkennung", "along", "off2").collect()))
    want = order(geometry.nearest_of_all(scaled, segs))
    left, whole = [], geometry.nearest_of_all
    monkeypatch.setattr(geometry, "nearest_of_all", lambda p, s: left.append(p.count()) or whole(p, s))
    assert order(geometry.projected(places, segs)) == want and len(want) == 2 * 128 + 2
    assert sum(left) < len(want) * 2 / 3  # the dense route is settled by cells
    box = segs.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lat0", "lat1", "lon0", "lon1") for f in (F.min, F.max)]).first()
    one = segs.where("line = 'L' and route = 0")
    assert geometry.cells(one, box, 16).count() < 1499 * 2 * 16


def test_positions_between_segments(spark):
    """A position after one segment's end and before the next one's start, which rounding makes, is at the end of the former."""
    kinds = "line string, route int, seg int, lat0 double, lon0 double, lat1 double, lon1 double, cum0 double, cum1 double"
    segs = spark.createDataFrame([("L", 0, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 1000.0), ("L", 0, 2, 0.0, 1.0, 0.0, 2.0, 1000.0 + 2e-13, 2000.0)], kinds)
    feet = spark.createDataFrame([("L", 0, 1, 1000.0, 0.0)], "line string, route int, vgnkennung int, along double, off2 double")
    trips_ = spark.createDataFrame([(7, "L", 1, 1, 0.5)], "id long, line string, vgnkennung int, next_vgnkennung int, progress double")
    got = geometry.estimated(trips_, feet, segs, F.col("progress")).first()
    assert (got.est_latitude, got.est_longitude) == (0.0, 1.0)


def test_radius_is_inclusive_of_the_point(spark):
    df = spark.createDataFrame([(1, 49.0, 11.0), (2, 49.0, 11.1), (3, None, 11.0)], "vgnkennung int, latitude double, longitude double")
    assert [r.vgnkennung for r in stops.in_radius(df, 49.0, 11.0, 10).collect()] == [1]
    assert stops.nearest(df, 10.0, 10.0, 10).count() == 0


def test_retention(spark):
    t0 = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(i, t0 - dt.timedelta(hours=i), 10) for i in range(30)], "id int, ts timestamp_ntz, size long").withColumn("newest", F.lit(t0).cast("timestamp_ntz"))
    assert {r.id for r in operations.retained(df, "ts", "size", "id", F.col("newest")).collect()} == set(range(25))
    assert {r.id for r in operations.retained(df, "ts", "size", "id", F.col("newest"), most_bytes=35).collect()} == {0, 1, 2}
