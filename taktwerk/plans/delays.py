"""Heatmaps, ranked lists and histograms of delays."""

from __future__ import annotations

import datetime as dt


from pyspark.sql import functions as F

from taktwerk.functions.text import control_room_class, minutes_seconds
from taktwerk.operators import delays as op
from taktwerk.plans.params import Histogram
from taktwerk.plans.registry import query
from taktwerk.sources.fixtures import DAY, FROM, TO, Fixtures

_BY_STOP = "SELECT avg(fh.abfahrt_v) AS avg_delay, vgnkennung, latitude, longitude, betriebstag FROM fahrten_halte fh JOIN haltestellen USING (vgnkennung) WHERE betriebstag {} AND abfahrt_v IS NOT NULL GROUP BY ALL"


def day_is(day: str = DAY):
    return F.col("betriebstag") == F.lit(day).cast("date")


def in_days(start: str = FROM, end: str = TO):
    return F.col("betriebstag").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


@query("heatmap_day", _BY_STOP.format(f"= DATE '{DAY}'"))
def heatmap_day(t: Fixtures):
    return op.mean_delay_by_stop(t.stop_events, t.stops, day_is())


@query("heatmap_range", _BY_STOP.format(f"BETWEEN DATE '{FROM}' AND DATE '{TO}'"))
def heatmap_range(t: Fixtures):
    return op.mean_delay_by_stop(t.stop_events, t.stops, in_days())


@query("toplist_stops", _BY_STOP.format(f"= DATE '{DAY}'") + " ORDER BY avg_delay DESC NULLS LAST, vgnkennung")
def toplist_stops(t: Fixtures):
    return op.ranked(op.mean_delay_by_stop(t.stop_events, t.stops, day_is()), "vgnkennung")


_BY = "SELECT {0}, avg(abfahrt_v) AS avg_delay, betriebstag FROM fahrten JOIN fahrten_halte USING (fahrtnummer, betriebstag, produkt) WHERE betriebstag = DATE '" + DAY + "' AND abfahrt_v IS NOT NULL GROUP BY ALL ORDER BY avg_delay DESC NULLS LAST, {0}"


@query("toplist_vehicles", _BY.format("fahrzeugnummer"))
def toplist_vehicles(t: Fixtures):
    return op.ranked(op.mean_delay_by(t.stop_events, t.trips, "fahrzeugnummer", day_is()), "fahrzeugnummer")


@query("toplist_lines", _BY.format("linienname"))
def toplist_lines(t: Fixtures):
    return op.ranked(op.mean_delay_by(t.stop_events, t.trips, "linienname", day_is()), "linienname")


@query(
    "toplist_stops_with_info",
    "SELECT avg_delay, m.vgnkennung, h.haltestellenname, array_to_string(h.vagkennung, ',') AS vagkennung FROM (SELECT avg(abfahrt_v) AS avg_delay, vgnkennung FROM fahrten_halte WHERE betriebstag = DATE '"
    + DAY + "' AND abfahrt_v IS NOT NULL GROUP BY 2) m LEFT JOIN haltestellen h USING (vgnkennung) WHERE EXISTS (SELECT 1 FROM haltestellen x WHERE x.vgnkennung = m.vgnkennung)",
)
def toplist_stops_with_info(t: Fixtures):
    top = op.mean_delay_by_stop(t.stop_events, t.stops, day_is()).select("avg_delay", "vgnkennung")
    info = t.stops.select("vgnkennung", "haltestellenname", F.array_join("vagkennung", ",").alias("vagkennung"))
    return op.ranked(top.join(info, "vgnkennung", "left").select("avg_delay", "vgnkennung", "haltestellenname", "vagkennung"), "vgnkennung")


_HIST = "SELECT (floor(fh.ankunft_v / 6e1) * 60)::DOUBLE AS bin_start, count(*) AS count FROM fahrten_halte fh JOIN fahrten f USING (fahrtnummer, betriebstag, produkt) WHERE betriebstag BETWEEN DATE '" + FROM + "' AND DATE '" + TO + "' AND fh.ankunft_v IS NOT NULL {} GROUP BY 1"
_HIST_CTE = ", h AS (" + _HIST.format("") + ")"


@query("delay_histogram", _HIST.format("") + " ORDER BY 1")
def delay_histogram(t: Fixtures):
    return op.histogram(t.stop_events, t.trips, FROM, TO)


@query("delay_histogram_filtered", _HIST.format("AND f.linienname = 'U1' AND produkt = 2 AND fh.ankunft_v >= -200 AND fh.ankunft_v <= 600"))
def delay_histogram_filtered(t: Fixtures):
    asked = Histogram(dt.date.fromisoformat(FROM), dt.date.fromisoformat(TO), min_delay=-200, max_delay=600, line="U1", product=2, vehicle=0)
    return op.histogram(t.stop_events, t.trips, asked.start.isoformat(), asked.end.isoformat(), line=asked.line, product=asked.product, vehicle=asked.vehicle, min_delay=asked.min_delay, max_delay=asked.max_delay)


@query("delay_histogram_pct", _HIST_CTE + " SELECT bin_start, count, count * 1e2 / (SELECT sum(count) FROM h) AS percentage FROM h")
def delay_histogram_pct(t: Fixtures):
    bins = op.histogram(t.stop_events, t.trips, FROM, TO)
    return bins.crossJoin(bins.agg(F.sum("count").alias("total"))).select("bin_start", "count", (F.col("count") * F.lit(100.0) / F.col("total")).alias("percentage"))


@query(
    "delay_histogram_layers",
    _HIST_CTE + ", l AS (SELECT 1 AS layer, * FROM (" + _HIST.format("AND produkt = 1") + ") UNION ALL SELECT 2, * FROM (" + _HIST.format("AND produkt = 2")
    + ")) SELECT layer, bin_start, coalesce(max(x.count), 0)::BIGINT AS count, coalesce(max(x.count) * 1e2 / max(s.total), 0) AS percentage FROM (SELECT DISTINCT bin_start FROM l) b CROSS JOIN (SELECT layer, sum(count) AS total FROM l GROUP BY 1) s"
    " LEFT JOIN l x USING (layer, bin_start) GROUP BY 1, 2",
)
def delay_histogram_layers(t: Fixtures):
    """Layers over the union of their bins, 0 where a layer has none: each bin is exploded into the layers, no join of all with all."""
    layers = [op.histogram(t.stop_events, t.trips, FROM, TO, product=p).withColumn("layer", F.lit(p)) for p in (1, 2)]
    rows = layers[0].unionByName(layers[1])
    wide = rows.groupBy("bin_start").agg(*[F.coalesce(F.sum(F.when(F.col("layer") == p, F.col("count"))), F.lit(0)).alias(f"n{p}") for p in (1, 2)])
    long = wide.select("bin_start", F.explode(F.array(*[F.struct(F.lit(p).alias("layer"), F.col(f"n{p}").alias("count")) for p in (1, 2)])).alias("x")).select("x.layer", "bin_start", "x.count")
    totals = rows.groupBy("layer").agg(F.sum("count").alias("total"))
    return long.join(totals, "layer").select("layer", "bin_start", "count", (F.col("count") * F.lit(100.0) / F.col("total")).alias("percentage"))


@query(
    "delay_labels",
    ", d AS (SELECT DISTINCT ankunft_v::INTEGER AS delay FROM fahrten_halte WHERE betriebstag = DATE '" + DAY + "' AND ankunft_v IS NOT NULL)"
    " SELECT delay, (CASE WHEN delay < 0 THEN '-' ELSE '' END) || (abs(delay) // 60)::VARCHAR || ':' || lpad((abs(delay) % 60)::VARCHAR, 2, '0') AS label,"
    " CASE WHEN abs(delay) >= 180 THEN (CASE WHEN delay < 0 THEN '>-3' ELSE '>3' END) ELSE (CASE WHEN delay < 0 THEN '-' ELSE '' END) || (abs(delay) // 60)::VARCHAR END AS control_room FROM d",
)
def delay_labels(t: Fixtures):
    delay = F.col("ankunft_v").cast("int")
    return t.stop_events.where(day_is() & F.col("ankunft_v").isNotNull()).select(delay.alias("delay")).distinct().select("delay", minutes_seconds(F.col("delay")).alias("label"), control_room_class(F.col("delay")).alias("control_room"))


@query(
    "colour_scale",
    ", m AS (" + _BY_STOP.format(f"= DATE '{DAY}'") + ") SELECT vgnkennung, CASE WHEN hi > lo THEN (avg_delay - lo) / (hi - lo) ELSE 0 END AS shade FROM m, (SELECT min(avg_delay) AS lo, max(avg_delay) AS hi FROM m)",
)
def colour_scale(t: Fixtures):
    """Where each stop's mean lies between the least and the greatest."""
    m = op.mean_delay_by_stop(t.stop_events, t.stops, day_is())
    ends = m.agg(F.min("avg_delay").alias("lo"), F.max("avg_delay").alias("hi"))
    return m.crossJoin(ends).select("vgnkennung", F.when(F.col("hi") > F.col("lo"), (F.col("avg_delay") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(0.0).alias("shade"))
