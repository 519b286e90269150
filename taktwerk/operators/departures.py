"""Departures as the stops list them: boards, the trip asked for, newly discovered trips, and whom to ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.plans.params import Departures
from taktwerk.sources.schema import TRIP_KEY


def board(events: DataFrame, trips: DataFrame, now: Column, asked: Departures) -> DataFrame:
    """(vgnkennung, fahrtnummer, betriebstag, produkt, linienname, departs, pos): what each stop lists, the earliest first.

    The window is a range of the planned departure, so it reaches the scan; the limit is one of each stop and cuts
    before the shuffle. Restrict ``events`` to the stops asked for.
    """
    begin = now + F.make_interval(mins=F.lit(asked.time_delay))
    own = F.col("abfahrt_soll").between(begin, begin + F.make_interval(mins=F.lit(asked.time_span)))
    if asked.product is not None:
        own &= F.col("produkt") == asked.product
    lines = trips.select(*TRIP_KEY, "linienname")
    if asked.line is not None:
        lines = lines.where(F.col("linienname") == asked.line)
    rows = events.where(own).select(*TRIP_KEY, "vgnkennung", "abfahrt_soll").join(lines, list(TRIP_KEY))
    order = Window.partitionBy("vgnkennung").orderBy("abfahrt_soll", "fahrtnummer", "produkt")
    rows = rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= asked.limit_count)
    return rows.select("vgnkennung", "fahrtnummer", "betriebstag", "produkt", "linienname", F.unix_millis(F.col("abfahrt_soll").cast("timestamp")).alias("departs"), "pos")


def matched(jobs: DataFrame, departures: DataFrame) -> DataFrame:
    """The first departure with the trip number of each job (vgnkennung, fahrtnummer); jobs without one keep their row."""
    first = departures.groupBy("vgnkennung", "fahrtnummer").agg(F.min_by("departs", "pos").alias("departs"))
    return jobs.join(first, ["vgnkennung", "fahrtnummer"], "left")


def discovered(departures: DataFrame, known: DataFrame, products: list[int]) -> DataFrame:
    """Departures of trips that are not ``known(fahrtnummer)`` and of the products asked for; of a trip that a stop lists
    twice the last counts. Departures without a trip number are none."""
    rows = departures.where(F.col("fahrtnummer").isNotNull() & (F.col("fahrtnummer") != 0) & F.col("produkt").isin(*products))
    rows = rows.join(known.select("fahrtnummer").distinct(), "fahrtnummer", "left_anti")
    return rows.groupBy("vgnkennung", "fahrtnummer").agg(F.max_by(F.struct("produkt", "departs"), "pos").alias("d")).select("vgnkennung", "fahrtnummer", "d.produkt", "d.departs")


def preferred_target(station: Column, vgn: Column, vag: Column) -> Column:
    """Whom to ask for departures: the known station's number, else the number given, else the code given."""
    given = [F.nullif(c.cast("string"), F.lit("0")) for c in (station, vgn)] + [vag]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in given])
