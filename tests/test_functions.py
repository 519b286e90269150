"""Expressions against hand-computed tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from taktwerk.functions import geo, text, timing


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_progress(spark):
    rows = [(500, 0, 1000, 0.3), (-5, 0, 1000, None), (2000, 0, 1000, None), (1000, 0, 1000, None), (5, None, 1000, 0.4), (5, 0, None, None), (5, 10, 10, 7.0)]
    got = values(spark, rows, "now long, start long, arr long, stored double", timing.progress(F.col("now"), F.col("start"), F.col("arr"), F.col("stored")))
    assert [g[0] for g in got] == [0.5, 0.0, 1.0, 1.0, 0.4, 0.0, 1.0]


def test_segment_start(spark):
    rows = [(None, 100, None, 200, None, None), (None, 100, 250, 200, 800, 900), (None, 190, None, 200, 800, 900), (None, 100, None, None, None, None), (None, None, 300, None, 900, 800), (-1, None, -1, 200, None, None)]
    got = values(spark, rows, "ai long, as long, di long, ds long, nai long, nas long", timing.segment_start(*[F.col(c) for c in ("ai", "as", "di", "ds", "nai", "nas")]))
    assert [g[0] for g in got] == [200, 150, 190, 100, 300, 200]


def test_next_run(spark):
    rows = [(0, 0, 1000), (600, 0, 1000), (1500, 0, 1000), (1500, None, None), (0, None, 900)]
    got = values(spark, rows, "now long, start long, nxt long", timing.next_run(F.col("now"), F.col("start"), F.col("nxt")))
    assert [g[0] for g in got] == [500.0, 1000.0, 31500.0, 301500.0, 900.0]


def test_delay(spark):
    rows = [(1000, None), (1000, 1000), (1000, 2999), (1000, 999), (None, 5)]
    assert [g[0] for g in values(spark, rows, "p long, a long", timing.delay_seconds(F.col("p"), F.col("a")))] == [0, 0, 1, -1, None]


def test_normal_time(spark):
    rows = [(None,), ("",), ("-1",), ("1700000000000",), ("1970-01-01T00:00:01Z",), ("nonsense",)]
    assert [g[0] for g in values(spark, rows, "t string", timing.normal_time(F.col("t")))] == [None, None, None, 1700000000000, 1000, None]


def test_codes(spark):
    rows = [("x:12",), ("x",), (None,), ("x:",), (" ab :3",)]
    assert [g[0] for g in values(spark, rows, "c string", text.platform(F.col("c")))] == [12, 0, 0, 0, 3]
    assert [g[0] for g in values(spark, rows, "c string", text.stop_code(F.col("c")))] == ["X", "X", "", "X", "AB"]
    assert [g[0] for g in values(spark, [("Richtung12a",), ("none",), (None,)], "c string", text.direction(F.col("c")))] == [12, 0, 0]
    assert [g[0] for g in values(spark, [("PVU",), ("17",), (None,), ("x",)], "c string", text.vehicle_number(F.col("c")))] == [0, 17, -1, -1]
    assert [g[0] for g in values(spark, [("Tram",), ("Boot",), (None,)], "c string", text.product_code(F.col("c")))] == [3, 0, 0]


@pytest.mark.parametrize("pattern, hits", [("a%c", ["abc", "xAbbCx"]), ("a_c", ["abc"]), (".", ["a.c"]), ("%", ["abc", "xAbbCx", "a.c"]), ("(", [])])
def test_pattern(spark, pattern, hits):
    df = spark.createDataFrame([("abc",), ("xAbbCx",), ("a.c",)], "s string")
    got = {r.s for r in df.where(text.matches_pattern(F.col("s"), pattern)).collect()}
    assert got == set(hits) | ({"a.c"} if pattern in ("a_c", "a%c") else set())


def test_labels(spark):
    rows = [(0,), (-5,), (61,), (-125,), (180,), (-181,), (3599,), (None,)]
    assert [g[0] for g in values(spark, rows, "s int", text.minutes_seconds(F.col("s")))] == ["0:00", "-0:05", "1:01", "-2:05", "3:00", "-3:01", "59:59", None]
    assert [g[0] for g in values(spark, rows, "s int", text.control_room_class(F.col("s")))] == ["0", "-0", "1", "-2", ">3", ">-3", ">3", ""]


def test_haversine(spark):
    got = values(spark, [(49.0, 11.0, 49.0, 11.0), (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double", geo.haversine(*[F.col(c) for c in "abcd"]))
    assert got[0][0] == 0
    assert math.isclose(got[1][0], 6_371_000 * math.pi / 180, rel_tol=1e-9)


def test_box_and_coordinates(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (float("nan"), 1.0), (None, 1.0), (91.0, 0.0)]
    assert [g[0] for g in values(spark, rows, "a double, b double", geo.in_box(F.col("a"), F.col("b"), (2, 2), (0, 0)))] == [True, True, False, False, False]
    assert [g[0] for g in values(spark, rows, "a double, b double", geo.valid_coordinate(F.col("a"), F.col("b")))] == [True, True, False, False, False]
    with pytest.raises(ValueError):
        geo.in_box(F.col("a"), F.col("b"), (1, 1), (1, 2))


def test_week_and_leap_day(spark):
    rows = [(dt.date(2024, 12, 30),), (dt.date(2021, 1, 3),), (dt.date(2024, 2, 29),)]
    got = values(spark, rows, "d date", F.year("d"), F.weekofyear("d"), timing.years_back(F.col("d"), 1))
    assert got == [(2024, 1, dt.date(2023, 12, 30)), (2021, 53, dt.date(2020, 1, 3)), (2024, 9, dt.date(2023, 2, 28))]


def test_metric_name(spark):
    assert values(spark, [("a.b c",), ("1x",)], "n string", text.metric_name(F.lit("P_"), F.col("n"))) == [("P_a_b_c",), ("P__1x",)]


def test_foot_on_a_segment(spark):
    rows = [(1, 0.5, 0.2), (2, 3.0, 0.0), (3, -1.0, 0.0), (4, None, 0.0)]
    points = spark.createDataFrame(rows, "id int, lat double, lon double")
    at = lambda lat1: geo.fraction_along(F.col("lat"), F.col("lon"), geo.plane_scale(F.col("lat")), F.lit(0.0), F.lit(0.0), F.lit(lat1).cast("double"), F.lit(0.0))
    got = {r.id: (r.f, r.point, r.open) for r in points.select("id", at(1.0).alias("f"), at(0.0).alias("point"), at(None).alias("open")).collect()}
    assert got == {1: (0.5, 0.0, None), 2: (1.0, 0.0, None), 3: (0.0, 0.0, None), 4: (None, None, None)}
