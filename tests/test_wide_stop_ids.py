"""Stop ids beyond 16 bits, as larger tables have them: the queries against their SQL, in which stops are integers too."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from taktwerk.plans.registry import ORACLE_SQL, QUERIES
from taktwerk.sources import tables
from taktwerk.sources.fixtures import Fixtures

SHIFT = 40_000
NAMES = """active_trips all_stops colour_scale delay_histogram delay_histogram_filtered delay_histogram_layers delay_histogram_pct delay_labels departure_of_trip departure_targets
departures_of_line departures_of_stops discovered_departures discovery_candidates discovery_diagnostics discovery_plan_diff discovery_plan_stats due_stop expired_trips first_future_stop
heatmap_range heatmap_day late_job_counts held_stop_events stop_sync stream_upserted_stop_events upstream_stops""".split()


@pytest.fixture(scope="module")
def wide(sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("wide"))
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(name)
        duckdb.execute(f"COPY (SELECT * {f'REPLACE ({key} + {SHIFT} AS {key})' if key else ''} FROM '{path}') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.fixture(scope="module")
def duck(wide):
    con = duckdb.connect()
    for path in glob.glob(f"{wide}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, wide, duck, name):
    sql = ORACLE_SQL[name]
    for narrow in ("(p_partkey + 1)::SMALLINT", "(l_partkey + 1)::SMALLINT", "st.vgnkennung)::SMALLINT"):
        sql = sql.replace(narrow, narrow.replace("SMALLINT", "INTEGER"))
    df = QUERIES[name](spark, wide)
    result = duck.execute(sql)
    order = [[d[0] for d in result.description].index(c) for c in df.columns]
    rows = [tuple(r[i] for i in order) for r in result.fetchall()]
    plain = lambda row: tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(plain, df.collect())) == sorted(map(plain, rows))


def test_type_by_the_keys(spark, sf, wide):
    for folder, kind in ((sf, "smallint"), (wide, "int")):
        t = Fixtures(spark, folder)
        assert dict(t.stops.dtypes)["vgnkennung"] == dict(t.stop_events.dtypes)["vgnkennung"] == kind


def test_line_order(spark, tmp_path):
    order = spark.createDataFrame([("U1", 1, SHIFT, 1)], "linienname string, richtung tinyint, vgnkennung int, pos int")
    tables.write_line_order(order, str(tmp_path / "o"))
    assert tables.read_line_order(spark, str(tmp_path / "o")).select(F.max("vgnkennung")).first()[0] == SHIFT
