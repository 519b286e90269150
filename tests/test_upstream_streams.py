"""Upstream answers as a data source, tracked trips, and sinks that a repeated batch does not change."""

import json

import pytest
from pyspark.sql import functions as F

from taktwerk.sources import feeds, upstream
from taktwerk.sources.fixtures import Fixtures
from taktwerk.streaming import sinks, tracking
from taktwerk.streaming.run import read_up

DAY_MS = 86_400_000


def poll(folder, kind, at, *answers):
    where = folder / kind / f"poll={at}"
    where.mkdir(parents=True, exist_ok=True)
    (where / "a.json").write_text("\n".join(a if isinstance(a, str) else json.dumps(a) for a in answers))


def trip(number, stops, day="2024-05-01", **more):
    return {"Fahrt": {"Fahrtnummer": number, "Betriebstag": day, "Produkt": "Bus", "Linienname": "36", "Richtung": "Richtung1", "Fahrtverlauf": stops} | more}


def stop(vgn, planned=None, actual=None):
    return {"VGNKennung": vgn, "AnkunftszeitSoll": planned, "AnkunftszeitIst": actual}


# ---------------------------------------------------------------- data source


def test_answers_to_rows(spark, tmp_path):
    poll(tmp_path, "trips", 5, {"Fahrt": {"Produkt": "Bus", "Fahrten": [{"Fahrtnummer": 1, "Betriebstag": "2024-05-01", "Besetztgrad": "Starkbesetzt", "FaelltAus": True}, {"Fahrtnummer": "2", "Betriebstag": "no day", "FaelltAus": "x"}, 7]}}, {"code": 503, "message": "down"})
    poll(tmp_path, "trips", 9, "", "{broken", {"Fahrt": {"Fahrten": []}})
    poll(tmp_path, "trip", 7, trip(3, [stop(1), stop(2)]), trip(4, []), {"Fahrt": None, "statusCode": 404})
    poll(tmp_path, "stops", 8, {"Haltestellen": [{"VGNKennung": 10, "VAGKennung": "A, B", "Latitude": 49.5, "Produkte": "Bus, Tram"}]})
    (tmp_path / "trips" / "poll=11").mkdir()  # nothing in it yet
    trips = [r.asDict() for r in upstream.reader(spark, str(tmp_path), "trips").orderBy("Fahrtnummer").collect()]
    assert [(t["poll"], t["Fahrtnummer"], t["Besetzgrad"], t["FaelltAus"], str(t["Betriebstag"])) for t in trips] == [(5, 1, "Starkbesetzt", True, "2024-05-01"), (5, 2, None, None, "None")]
    one = upstream.reader(spark, str(tmp_path), "trip").first()
    assert one.Fahrtnummer == 3 and [s.VGNKennung for s in one.Fahrtverlauf] == [1, 2]
    errors = {(r.poll, r.kind, r.code, r.message) for r in upstream.reader(spark, str(tmp_path), "errors").collect()}
    assert errors == {(5, "trips", 503, "down"), (9, "trips", 500, "not JSON"), (7, "trip", 500, None), (7, "trip", 404, None)}
    listed = feeds.listed_stops(upstream.reader(spark, str(tmp_path), "stops")).first()
    assert (listed.vagkennung, listed.produkt_bus, listed.produkt_tram, listed.produkt_ubahn) == (["A", "B"], 1, 1, 0)
    assert feeds.active_trips(upstream.reader(spark, str(tmp_path), "trips")).where("fahrtnummer = 1").first().besetzungsgrad == 3


def test_polls_in_bounds(spark, tmp_path):
    for at in (3, 5, 8):
        poll(tmp_path, "trip", at, trip(at, [stop(1)]))
    got = lambda **o: sorted(r.Fahrtnummer for r in upstream.reader(spark, str(tmp_path), "trip", **o).collect())
    assert (got(), got(fromPoll=4), got(toPoll=5), got(fromPoll=4, toPoll=7)) == ([3, 5, 8], [5, 8], [3, 5], [5])
    assert upstream.reader(spark, str(tmp_path), "stops").collect() == []
    with pytest.raises(Exception, match="kind"):
        upstream.reader(spark, str(tmp_path), "planes")


def test_restarted_stream_loses_and_repeats_nothing(spark, tmp_path):
    seen, numbers = [], []

    def write(batch, number):
        numbers.append(number)
        seen.extend(r.Fahrtnummer for r in batch.collect())

    for at in (1, 2):
        poll(tmp_path, "trip", at, trip(at, [stop(1)]), trip(10 + at, [stop(1)]))
    run = lambda: read_up(upstream.reader(spark, str(tmp_path), "trip", stream=True), write, str(tmp_path / "c"))
    run()
    assert sorted(seen) == [1, 2, 11, 12]
    run()
    assert sorted(seen) == [1, 2, 11, 12]
    poll(tmp_path, "trip", 7, trip(7, [stop(1)]))
    run()
    poll(tmp_path, "trip", 9, trip(9, [stop(1)]))
    run()
    assert sorted(seen) == [1, 2, 7, 9, 11, 12]


# ---------------------------------------------------------------- tracked trips


def tracked(spark, folder, rounds):
    """The log of polls that come in rounds, one run of the query for each."""
    table = sinks.Table(str(folder / "log"), tracking.LOG)
    for polls in rounds:
        for at, answers in polls:
            poll(folder, "trip", at, *answers)
        read_up(tracking.tracked(feeds.itineraries(upstream.reader(spark, str(folder), "trip", stream=True))), table.sink("log"), str(folder / "c"), "update")
    return table.rows(spark).drop("batch").where("fahrtnummer > 0"), str(folder / "c")


def states(spark, checkpoint):
    return sum(spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count() for name in ("trip", "answers", "recorded"))


def at(minute):
    return f"2024-05-01T08:{minute:02d}:00Z"


MS = 1714550400000  # 2024-05-01T08:00:00Z


def test_a_trip_step_by_step(spark, tmp_path):
    early = trip(1, [stop(10, at(0)), stop(20, at(10)), stop(30, at(20))])
    late = trip(1, [stop(10, at(0), at(0)), stop(20, at(10), at(14)), stop(30, at(20), at(26))])
    log, checkpoint = tracked(spark, tmp_path, [[(MS - 60_000, [early])], [(MS + 6 * 60_000, [late])], [(MS + DAY_MS, [trip(-1, [stop(0)])])]])
    rows = [((r.at_ms - MS) // 1000, r.kind, r.vgnkennung, r.next_vgnkennung, r.progress) for r in log.orderBy("at_ms", F.col("kind") != "stop").collect()]
    assert rows == [
        (0, "stop", 10, None, None), (0, "live", 10, 20, 0.0), (300, "live", 10, 20, 0.5), (600, "live", 10, 20, 600 / 840),  # half way by plan; then it is late
        (840, "stop", 20, None, None), (840, "live", 20, 30, 0.0), (1200, "live", 20, 30, 0.5), (1560, "stop", 30, None, None), (1560, "finished", 30, None, None),
    ]
    assert tracking.live(log).count() == 0 and states(spark, checkpoint) == 0


def test_trips_that_end_otherwise(spark, tmp_path):
    over = trip(2, [stop(10, at(0)), stop(20, at(1))])  # polled when it is over
    broken = trip(3, [stop(10, at(0)), stop(20, None)])  # its last stop has no time
    none = trip(4, [stop(10, None), stop(20, at(5))])  # no start
    log, checkpoint = tracked(spark, tmp_path, [[(MS + 600_000, [over, broken, none])], [(MS + DAY_MS, [trip(-1, [stop(0)])])]])
    last = {r.fahrtnummer: r.kind for r in log.where("kind not in ('stop', 'live')").collect()}
    assert last == {2: "invalid", 3: "invalid", 4: "invalid"}
    assert states(spark, checkpoint) == 0


class Held:
    """A state, for a tracker without a stream."""

    def __init__(self):
        self.value = []

    def exists(self):
        return bool(self.value)

    def get(self):
        return self.value if isinstance(self.value, tuple) else iter(self.value)

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, more):
        self.value = [*self.value, *more]

    def clear(self):
        self.value = []


class Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Held())

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 1 << 50


def log_of(*answers):
    handle, tracker = Handle(), tracking.Tracker()
    tracker.init(handle)
    out = list(tracker.handleInputRows((None, 1, 1), iter({"poll": p, "linienname": "36", "richtung": 1, "stops": [dict(zip(tracking.TIMES, s)) for s in stops]} for p, stops in answers), handle))
    out += tracker.handleExpiredTimer((None, 1, 1), handle, None)
    return [(r.kind, r.at_ms) for r in out], not any(s.exists() for s in handle.states.values())


def test_expired_and_failed():
    stops = [(1, 0, None, None, None), (2, None, None, None, None), (3, 600_000, None, None, None)]
    log, gone = log_of((-5, [*stops[:2], (3, 600_000, None, None, None), (4, None, None, None, 700_000)]))
    assert log[-1] == ("finished", 700_000) and ("live", 300_000) in log and gone  # five minutes at a time while the next stop has no time
    log, gone = log_of((0, stops), (1, [(1, 0, None, None, None), (2, None, None, None, None), (3, None, None, None, None)]))
    assert log[-1] == ("expired", tracking.KEEP_MS) and gone
    tries = [0, 1000, 3000, 7000, 15_000]
    log, gone = log_of((7, []))
    assert log == [("failed", 7 + tries[-1])] and gone
    log, gone = log_of((7, []), (4000, [(1, 0, None, None, None), (2, 9000, None, None, None)]))
    assert log == [("stop", 7007), ("live", 7007), ("stop", 9000), ("finished", 9000)] and gone
    assert tracking.look(tracking.named([(1, 0, None, None, None), (2, None, None, None, None)]), 50).next_run == 50 + tracking.LATER_MS


def test_index_of_live_trips(spark, tmp_path):
    first = [(MS - 60_000, [trip(1, [stop(10, at(0)), stop(20, at(10))]), trip(2, [stop(10, at(0)), stop(30, at(40))])])]
    log, _ = tracked(spark, tmp_path, [first, [(MS + 900_000, [trip(-1, [stop(0)])])]])
    assert [(r.linienname, r.richtung, r.next_vgnkennung, r.fahrtnummer, r.expires_ms) for r in tracking.index_rows(tracking.live(log)).collect()] == [("36", 1, 30, 2, MS + 40 * 60_000 + tracking.KEEP_MS)]


def test_replay_in_any_batches(spark, sf, tmp_path):
    """The fixtures' trips in one round and in several give one log; every reached stop is in it once; no state is left."""
    answers = Fixtures(spark, sf).trip_answers("1995-06-01", "1995-06-30")
    logs = []
    for rounds in (1, 4):
        folder = tmp_path / str(rounds)
        cuts = answers.selectExpr(f"percentile_approx(poll, array({','.join(str(i / rounds) for i in range(1, rounds))}))").first()[0] if rounds > 1 else []
        edges = [0, *cuts, 1 << 62]
        table = sinks.Table(str(folder / "log"), tracking.LOG)
        for low, high in zip(edges, edges[1:]):
            upstream.keep(answers.where((F.col("poll") > low) & (F.col("poll") <= high)), str(folder), "trip")
            read_up(tracking.tracked(feeds.itineraries(upstream.reader(spark, str(folder), "trip", stream=True))), table.sink("log"), str(folder / "c"), "update")
        assert states(spark, str(folder / "c")) == 0
        logs.append(table.rows(spark).drop("batch").where("fahrtnummer > 0"))
    assert logs[0].exceptAll(logs[1]).count() == 0 and logs[1].exceptAll(logs[0]).count() == 0
    stops = logs[0].where("kind = 'stop'")
    assert stops.count() == stops.select(*tracking.KEY, "vgnkennung").distinct().count() > 0
    assert logs[0].where("kind = 'finished'").count() == logs[0].select(*tracking.KEY).distinct().count()


# ---------------------------------------------------------------- sinks


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_twice_and_compaction(spark, tmp_path):
    table = sinks.Table(str(tmp_path / "t"), "id bigint, day date, value string, at bigint", ("id",), ("at",), "day")
    write, other = table.sink("a"), table.sink("b")
    batch = lambda *rows: spark.createDataFrame(rows, "id bigint, day string, value string, at bigint").withColumn("day", F.col("day").cast("date"))
    assert values(table.latest(spark)) == []
    write(batch((1, "2024-01-01", "x", 1), (2, "2024-02-01", "y", 1)), 0)
    write(batch((1, "2024-01-01", "z", 2)), 1)
    before = values(table.latest(spark).select("id", "value"))
    assert before == [(1, "z"), (2, "y")]
    write(batch((1, "2024-01-01", "again", 9)), 1)  # the batch is known
    assert values(table.latest(spark).select("id", "value")) == before
    other(batch((3, "2024-01-05", "w", 1)), 1)  # another query's batch 1
    assert values(table.rows(spark).select("id", "value")) == [(1, "x"), (1, "z"), (2, "y"), (3, "w")]
    before = values(table.latest(spark))
    table.compact(spark)
    assert values(table.latest(spark)) == before and table.rows(spark).count() == 3
    write(batch((2, "2024-02-01", "again", 9)), 0)
    removed = table.vacuum(spark)
    assert len(removed) == 6 and values(table.latest(spark)) == before
    write(batch((2, "2024-02-01", "again", 9)), 1)
    assert values(table.latest(spark)) == before
    write(batch((2, "2024-02-01", "new", 0), (2, "2024-02-01", "newer", 5)), 2)
    table.compact(spark)
    table.compact(spark)
    assert values(table.latest(spark).select("id", "value")) == [(1, "z"), (2, "newer"), (3, "w")]
    assert "yyyymm" in table.rows(spark).columns


def test_half_a_batch_is_not_seen(spark, tmp_path):
    table = sinks.Table(str(tmp_path / "t"), "id bigint, value string", ("id",))
    rows = spark.createDataFrame([(1, "x")], "id bigint, value string")
    table.sink("a")(rows, 0)
    table._write(spark.createDataFrame([(1, "lost", 1)], "id bigint, value string, batch bigint"), "a-1")  # written, not entered
    assert values(table.latest(spark)) == [(1, "x")]
    table.sink("a")(spark.createDataFrame([(1, "y")], "id bigint, value string"), 1)
    assert values(table.latest(spark)) == [(1, "y")]


def test_appended_rows_all_stay(spark, tmp_path):
    table = sinks.Table(str(tmp_path / "t"), "name string, value double")
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "name string, value double")
    for n in range(3):
        table.sink("m")(rows, n)
    table.compact(spark)
    assert table.rows(spark).count() == 6


def test_switch(spark, tmp_path):
    settings = sinks.Table(str(tmp_path / "s"), "key string, value string, at bigint", ("key",), ("at",))
    put = lambda value, at: settings.sink("s")(spark.createDataFrame([("trace", value, at)], settings.schema), at)
    written = []
    write = sinks.switched(lambda df, n: written.append(n), sinks.switch(settings, "trace"), hold=0.0)
    df = spark.range(1)
    write(df, 0)
    put("0", 1)
    write(df, 1)
    put("1", 2)
    write(df, 2)
    assert written == [0, 2]
    held = sinks.switched(lambda df, n: written.append(n), lambda s: written.append("asked") or True, hold=60.0)
    held(df, 3)
    held(df, 4)
    assert written[2:] == ["asked", 3, 4]
