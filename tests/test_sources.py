"""Tables, migrations, feeds and small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from taktwerk.operators.versioned import on_day
from taktwerk.sources import feeds, schema, tables


def test_upsert_and_month_folders(spark, tmp_path):
    path = str(tmp_path / "trips")
    row = lambda occupancy, day, at: (1, day, 2, "U1", occupancy, 7, 1, 0, at)
    for occupancy, at in ((1, dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 2))):
        tables.append(spark.createDataFrame([row(occupancy, dt.date(2024, 1, 5), at), row(occupancy, dt.date(2024, 2, 5), at)], schema.TRIPS), path, "betriebstag")
    merged = tables.read_latest(spark, path, schema.TRIPS, schema.TRIP_KEY, "updated_at")
    assert sorted((r.betriebstag.month, r.besetzungsgrad) for r in merged.collect()) == [(1, 3), (2, 3)]
    plan = on_day(spark.read.parquet(path), "betriebstag", "2024-01-05")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan and "202401" in plan


def test_migrations_run_once(spark, tmp_path):
    ran = []
    steps = [("002", "b", lambda s: ran.append("002")), ("001", "a", lambda s: ran.append("001"))]
    assert tables.migrate(spark, str(tmp_path / "m"), steps) == ["001", "002"]
    assert tables.migrate(spark, str(tmp_path / "m"), [*steps, ("003", "c", lambda s: ran.append("003"))]) == ["003"]
    assert ran == ["001", "002", "003"]


def test_line_order_round_trip(spark, tmp_path):
    order = spark.createDataFrame([("U1", 1, 5, 1), ("U1", 1, 9, 2), ("U1", 2, 9, 1)], "linienname string, richtung tinyint, vgnkennung smallint, pos int")
    tables.write_line_order(order, str(tmp_path / "o"))
    assert sorted(map(tuple, tables.read_line_order(spark, str(tmp_path / "o")).select(*order.columns).collect())) == sorted(map(tuple, order.collect()))


def test_geometry_of_both_nestings(spark, tmp_path):
    (tmp_path / "g.json").write_text("\n".join(json.dumps({"line": n, "coordinates": c}) for n, c in (("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]]))))
    got = sorted(tuple(r) for r in tables.read_geometry(spark, str(tmp_path / "g.json")).collect())
    assert got == [("a", 0, 0, 2.0, 1.0), ("a", 0, 1, 4.0, 3.0), ("b", 0, 0, 2.0, 1.0), ("b", 0, 1, 4.0, 3.0), ("b", 1, 0, 6.0, 5.0), ("b", 1, 1, 8.0, 7.0)]


def test_feed(spark, tmp_path):
    stop = {"VGNKennung": 5, "Haltepunkt": "X:3", "AnkunftszeitSoll": None, "AnkunftszeitIst": None, "AbfahrtszeitSoll": "2024-01-05T10:00:00.900Z", "AbfahrtszeitIst": "2024-01-05T10:01:30Z"}
    last = {"VGNKennung": 6, "Haltepunkt": "Y", "AnkunftszeitSoll": "2024-01-05T10:20:00Z", "AnkunftszeitIst": None, "AbfahrtszeitSoll": None, "AbfahrtszeitIst": None}
    trip = {"Fahrtnummer": 1, "Betriebstag": "2024-01-05", "Produkt": "UBahn", "Linienname": "U1", "Fahrzeugnummer": "PVU", "Besetzgrad": "Starkbesetzt", "Richtung": "Richtung2", "FaelltAus": None, "Fahrtverlauf": [stop, last]}
    (tmp_path / "f.json").write_text(json.dumps(trip) + "\n" + json.dumps({"Fahrtnummer": 2, "Fahrtverlauf": []}))
    feed = feeds.read_trips(spark, str(tmp_path / "f.json"))
    first = feeds.trips(feed).where("fahrtnummer = 1").first()
    assert (first.produkt, first.besetzungsgrad, first.fahrzeugnummer, first.richtung, first.faelltaus) == (2, 3, 0, 2, 0)
    assert (first.starts, first.ends) == (1704448800900, 1704450000000)
    assert feeds.trips(feed).where("fahrtnummer = 2").first().starts is None
    events = [(r.vgnkennung, r.haltepunkt, r.ankunft_v, r.abfahrt_v, r.abfahrt_soll) for r in feeds.stop_events(feed).orderBy("idx").collect()]
    assert events == [(5, 3, None, 89, dt.datetime(2024, 1, 5, 10)), (6, 0, 0, None, None)]


def test_dead_letters(spark, tmp_path):
    tables.dead_letters(spark.range(2), "no answer", str(tmp_path / "d"))
    assert sorted(r["row"] for r in spark.read.parquet(str(tmp_path / "d")).collect()) == ['{"id":0}', '{"id":1}']


def test_older_tables_lack_a_column(spark):
    from taktwerk.operators.versioned import with_column_default

    assert with_column_default(spark.range(1), "faelltaus", 0, "smallint").first().faelltaus == 0
    assert with_column_default(spark.range(1).withColumn("faelltaus", F.lit(1)), "faelltaus", 0, "smallint").first().faelltaus == 1
