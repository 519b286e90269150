"""Streaming operators against their batch twins."""

import time

import pytest

from pyspark.sql import functions as F

from taktwerk.operators.operations import limited
from taktwerk.plans.registry import ORACLE_SQL, QUERIES
from taktwerk.operators import summary
from taktwerk.streaming import queries, sinks
from taktwerk.streaming.run import drained, read_up, table_stream


def test_limiter_counts_as_the_fold(spark, sf):
    calls = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.lit(1.0).alias("cost"))
    batch = {r.user_id: (r.p, r.b) for r in limited(calls, "user_id", "ms", "cost").groupBy("user_id").agg(F.count_if(~F.col("blocked")).alias("p"), F.count_if("blocked").alias("b")).collect()}
    assert {r.id: (r.passed, r.blocked) for r in QUERIES["stream_rate_limiter"](spark, sf).collect()} == batch


def test_snapshots_run_on_a_clock(spark, sf, tmp_path):
    seen = []
    stream = table_stream(spark, sf, "events").groupBy("event_type").count()
    query = queries.snapshots(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c"), "200 milliseconds")
    for _ in range(300):
        if seen:
            break
        time.sleep(0.1)
    query.stop()
    assert seen[0] == 5


@pytest.mark.parametrize("rows", [7, 512, 10_000])
def test_states_do_not_depend_on_chunks(spark, sf, same_rows, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        assert same_rows(QUERIES["stream_trip_state"](spark, sf), ORACLE_SQL["stream_trip_state"])
    finally:
        spark.conf.set(name, before)


def test_streams_of_folders_and_of_nothing(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(str(tmp_path / "none.parquet"))
    count = lambda name: drained(table_stream(spark, str(tmp_path), name)).count()
    assert count("events") == spark.read.parquet(f"{sf}/events.parquet").count()
    assert count("none") == 0


def test_calls_are_paired_across_batches(spark, tmp_path):
    """A response in a later batch, one that is late, one without a request; timeouts come when nothing can answer them any more."""
    table = sinks.Table(str(tmp_path / "t"), "request_id bigint, requested_at timestamp, duration_us bigint")
    at = lambda minute: f"2024-01-01 {10 + minute // 60:02d}:{minute % 60:02d}:00"
    rounds = [[(1, 0, "request"), (2, 1, "request"), (9, 1, "response")], [(1, 30, "response"), (3, 40, "request"), (2, 62, "response")], [(4, 400, "request"), (4, 400, "response")]]
    for n, rows in enumerate(rounds):
        spark.createDataFrame([(i, at(m), p) for i, m, p in rows], "request_id bigint, ts string, phase string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        side = lambda phase: spark.readStream.schema("request_id bigint, ts timestamp, phase string").parquet(str(tmp_path / "in")).where(f"phase = '{phase}'").drop("phase")
        read_up(queries.paired(side("request"), side("response"), "1 hour"), table.sink("p"), str(tmp_path / "c"))
    got = sorted((r.request_id, r.duration_us and r.duration_us // 60_000_000) for r in table.rows(spark).collect())
    assert got == [(1, 30), (2, None), (3, None), (4, 0)]


def test_summaries(spark, tmp_path):
    measured = summary.Measured()
    rows, told = measured.run(measured.counted(spark.range(1000)).where("id % 10 = 0"), lambda df: df.collect())
    assert (len(rows), told.read_rows, told.result_rows) == (100, 1000, 100) and told.rows_a_second == 1000 / (told.elapsed_ns / 1e9)
    none = summary.Measured()
    assert none.run(none.counted(spark.range(0)), lambda df: df.count())[1][:2] == (0, 0)
    listener = summary.StreamSummaries(most=5)
    spark.streams.addListener(listener)
    try:
        spark.range(70).write.parquet(str(tmp_path / "in"))
        read_up(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), lambda df, n: df.count(), str(tmp_path / "c"))
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(rows for _, _, rows, _ in listener.batches) == 70 and list(listener.ended.values()) == [None]
