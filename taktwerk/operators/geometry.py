"""Line geometry as segments, map matching of stops, and positions along a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from taktwerk.functions.geo import GEOMETRY_RADIUS, clamp01, fraction_along, haversine, plane_scale, squared_offset, valid_coordinate
from taktwerk.sources.scratch import stored

#: Metres along a route, or more, by which segments and positions are brought together.
CELL = 1000.0
#: Cells of a grid on either side at most, how many times fewer the next grid has, and what part of a cell's height a place looks around.
GRID, COARSER, AROUND = 256, 4, 1 / 64
#: Cells by which the cells of a segment are drawn wider, for what rounding may do.
PAD = 1e-6
#: Segments of a route in a block; shares of a line's blocks that are compared with its places by tasks of their own.
BLOCK, SHARES = 64, 64


def segments(points: DataFrame) -> DataFrame:
    """(line, route, seg, lat0, lon0, lat1, lon1, cum0, cum1) from points (line, route, pos, latitude, longitude).

    A route with a point that is no coordinate, or with fewer than two points, has no segments.
    """
    route = Window.partitionBy("line", "route")
    ok = F.min(valid_coordinate(F.col("latitude"), F.col("longitude"))).over(route) & (F.count("*").over(route) > 1)
    w = route.orderBy("pos")
    rows = points.withColumn("ok", ok).where("ok").withColumns({"lat1": F.lead("latitude").over(w), "lon1": F.lead("longitude").over(w), "seg": F.row_number().over(w)}).where("lat1 is not null")
    rows = rows.withColumn("metres", haversine(F.col("latitude"), F.col("longitude"), F.col("lat1"), F.col("lon1"), GEOMETRY_RADIUS))
    cum1 = F.sum("metres").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cum1", cum1).select("line", "route", "seg", F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"), "lat1", "lon1", (F.col("cum1") - F.col("metres")).alias("cum0"), "cum1")


def _offset(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of a place, with its scale, and a segment with f, the foot's share of the segment, and the squared offset from it."""
    f = fraction_along(F.col("latitude"), F.col("longitude"), F.col("scale"), F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    off2 = squared_offset(F.col("latitude"), F.col("longitude"), F.col("scale"), F.col("lat0") + (F.col("lat1") - F.col("lat0")) * F.col("f"), F.col("lon0") + (F.col("lon1") - F.col("lon0")) * F.col("f"))
    return rows.withColumn("f", f), off2


def projected(places: DataFrame, segs: DataFrame) -> DataFrame:
    """(line, route, vgnkennung, along, off2): the nearest point of each route of its line for each place, the first of ties.

    Places of one point are looked up once. A place meets the segments that cross its cell of a grid (``near``); what lies
    within the distance that it looks around is the nearest for certain. Places that find nothing so near on a route
    go on to coarser grids, and what the coarsest leaves meets all segments of its route (``nearest_of_all``).
    """
    point = Window.partitionBy("line", "latitude", "longitude")
    places = places.withColumns({"scale": plane_scale(F.col("latitude")), "first": F.min("vgnkennung").over(point)})
    single = stored(places.where("vgnkennung = first").drop("first"), "points")
    routes = segs.select("line", "route").distinct()
    left = stored(single.select("line", "vgnkennung").join(routes, "line"), "places-to-match")
    box = segs.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lat0", "lat1", "lon0", "lon1") for f in (F.min, F.max)]).first()
    most = single.groupBy("line").count().agg(F.max("count")).first()[0] or 0
    size = min(GRID, int(most**0.5))
    done = []
    while size > 1 and not left.isEmpty():
        found = stored(near(single, left, segs, box, size), "matched")
        done.append(found)
        left = stored(left.join(found, ["line", "route", "vgnkennung"], "left_anti"), "places-to-match")
        size //= COARSER
    if not done or not left.isEmpty():
        done.append(nearest_of_all(single.join(left, ["line", "vgnkennung"]), segs))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("vgnkennung", "first").join(places.select("line", "first", "vgnkennung"), ["line", "first"]).select("line", "route", "vgnkennung", "along", "off2")


def cells(segs: DataFrame, box: Row, size: int) -> DataFrame:
    """A row for each cell (ix, iy) of a grid over ``box`` that a segment crosses: its columns, and in each the rows between
    the heights at which it enters and leaves."""
    (x, width), (y, height) = _grid(box, size)
    u0, u1, v0, v1 = ((F.col(c) - low) / step for c, low, step in (("lon0", x, width), ("lon1", x, width), ("lat0", y, height), ("lat1", y, height)))
    index = lambda c: F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor(c).cast("int")))
    span = lambda a, b: F.explode(F.sequence(index(F.least(a, b) - PAD), index(F.greatest(a, b) + PAD)))
    inside = lambda c: F.greatest(F.least(u0, u1), F.least(F.greatest(u0, u1), c))
    at = lambda c: v0 + (inside(c) - u0) / F.nullif(u1 - u0, F.lit(0.0)) * (v1 - v0)
    rows = segs.withColumn("ix", span(u0, u1))
    enter, leave = (F.when(u0 == u1, v).otherwise(at(F.col("ix") + side)) for v, side in ((v0, -PAD), (v1, 1 + PAD)))
    return rows.withColumn("iy", span(enter, leave))


def _grid(box: Row, size: int) -> tuple[tuple[float, float], tuple[float, float]]:
    """West and width, south and height of the cells."""
    out = []
    for c in ("lon", "lat"):
        low, high = min(box[f"min_{c}0"], box[f"min_{c}1"]), max(box[f"max_{c}0"], box[f"max_{c}1"])
        out.append((low, max((high - low) / size, 1e-9)))
    return out[0], out[1]


def near(places: DataFrame, left: DataFrame, segs: DataFrame, box: Row, size: int) -> DataFrame:
    """``projected`` for the places and routes in ``left`` that have a segment within ``AROUND`` of a cell's height."""
    (x, width), (y, height) = _grid(box, size)
    around = height * AROUND
    index = lambda c: F.floor(c).cast("int")
    reach = lambda c, low, step, by: F.explode(F.sequence(F.greatest(F.lit(0), index((c - by - low) / step - PAD)), F.least(F.lit(size - 1), index((c + by - low) / step + PAD))))
    aside = F.least(F.lit(360.0), F.lit(around) / F.nullif(F.col("scale"), F.lit(0.0)))
    within = lambda c, low, step, by: ((c + by - low) / step + PAD >= 0) & ((c - by - low) / step - PAD < size)
    lon, lat = (F.col("longitude"), x, width, aside), (F.col("latitude"), y, height, F.lit(around))
    dealt = places.where(within(*lon) & within(*lat)).withColumn("ix", reach(*lon)).withColumn("iy", reach(*lat))
    dealt = dealt.join(left.select("line", "vgnkennung").distinct(), ["line", "vgnkennung"], "left_semi")
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = segs.join(left.select("line", "route").distinct(), ["line", "route"], "left_semi").repartition(tasks, "line", "route", "seg")
    pairs, off2 = _offset(cells(some, box, size).join(dealt, ["line", "ix", "iy"]))
    # numbers in hash aggregations, which nothing sorts; few offsets of a place differ that are so small
    least = pairs.withColumn("off2", off2).where(F.col("off2") <= around * around * (1 - PAD)).groupBy("line", "route", "vgnkennung", "off2").agg(F.min("seg").alias("seg"))
    best = least.groupBy("line", "route", "vgnkennung").agg(F.min(F.struct("off2", "seg")).alias("b")).select("line", "route", "vgnkennung", "b.seg")
    best = best.join(left, ["line", "route", "vgnkennung"], "left_semi")
    pairs, off2 = _offset(best.join(places, ["line", "vgnkennung"]).join(segs, ["line", "route", "seg"]))
    along = F.col("cum0") + (F.col("cum1") - F.col("cum0")) * F.col("f")
    return pairs.select("line", "route", "vgnkennung", along.alias("along"), off2.alias("off2"))


def nearest_of_all(places: DataFrame, segs: DataFrame) -> DataFrame:
    """``projected`` for rows of a place and a route, from all segments of the route, dealt in shares. The least offset by
    blocks of a route is a number in a hash aggregation; only the best block is looked at segment by segment."""
    blocks = segs.withColumn("block", F.floor(F.col("seg") / BLOCK)).withColumn("share", F.pmod("block", F.lit(SHARES)).cast("int"))
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(tasks, "line", "route", "share")
    pairs, off2 = _offset(dealt.join(blocks, ["line", "route", "share"]))
    least = pairs.groupBy("line", "route", "vgnkennung", "block").agg(F.min(off2).alias("off2"))
    best = least.groupBy("line", "route", "vgnkennung").agg(F.min(F.struct("off2", "block")).alias("b")).select("line", "route", "vgnkennung", "b.block")
    pairs, off2 = _offset(best.join(places, ["line", "route", "vgnkennung"]).join(blocks.drop("share"), ["line", "route", "block"]))
    along = F.col("cum0") + (F.col("cum1") - F.col("cum0")) * F.col("f")
    nearest = F.min(F.struct(off2.alias("off2"), F.col("seg"), along.alias("along")))
    return pairs.groupBy("line", "route", "vgnkennung").agg(nearest.alias("b")).select("line", "route", "vgnkennung", "b.along", "b.off2")


def estimated(pairs: DataFrame, projections: DataFrame, segs: DataFrame, progress: Column) -> DataFrame:
    """Adds est_latitude and est_longitude to rows (id, line, vgnkennung, next_vgnkennung, ...): on the route nearest to
    both stops, ``progress`` of the way between their feet; null where a line has no geometry. ``id`` is unique.

    A row meets the segments in its cell along the route, of ``CELL`` metres or a mean segment's, by an equi-join."""
    here = projections.select("line", "route", "vgnkennung", F.col("along").alias("a0"), F.col("off2").alias("o0"))
    there = projections.select("line", "route", F.col("vgnkennung").alias("next_vgnkennung"), F.col("along").alias("a1"), F.col("off2").alias("o1"))
    pairs_ = pairs.withColumn("share", clamp01(progress)).select("id", "line", "vgnkennung", "next_vgnkennung", "share")
    both = pairs_.join(here, ["line", "vgnkennung"]).join(there, ["line", "route", "next_vgnkennung"])
    target = F.col("a0") + (F.col("a1") - F.col("a0")) * F.col("share")
    route = both.groupBy("id", "line").agg(F.min(F.struct((F.col("o0") + F.col("o1")).alias("o"), F.col("route"), target.alias("d"))).alias("r")).select("id", "line", "r.route", "r.d")
    ends_of = segs.groupBy("line", "route").agg(F.max("seg").alias("last"), F.greatest(F.lit(CELL), F.max("cum1") / F.max("seg")).alias("width"))
    cell = lambda d: F.floor(F.col(d) / F.col("width"))
    ends = segs.join(ends_of, ["line", "route"]).withColumn("is_last", F.col("seg") == F.col("last"))
    # rounding may leave a gap before the next segment's start; of segments that begin by then the last counts
    ends = ends.withColumn("upto", F.col("cum1") * (1 + 1e-12)).withColumn("cell", F.explode(F.sequence(cell("cum0"), cell("upto") + F.col("is_last").cast("int")))).drop("last", "width")
    route = route.join(ends_of, ["line", "route"]).withColumn("cell", cell("d")).drop("last", "width")
    on = (F.col("d") >= F.col("cum0")) | (F.col("seg") == 1)
    found = route.join(ends, ["line", "route", "cell"]).where(on & ((F.col("d") < F.col("upto")) | F.col("is_last")))
    part = F.when(F.col("cum1") > F.col("cum0"), (F.col("d") - F.col("cum0")) / F.nullif(F.col("cum1") - F.col("cum0"), F.lit(0.0))).otherwise(0.0)
    found = found.withColumn("part", part).groupBy("id").agg(F.max_by(F.struct((F.col("lat0") + (F.col("lat1") - F.col("lat0")) * F.col("part")).alias("est_latitude"), (F.col("lon0") + (F.col("lon1") - F.col("lon0")) * F.col("part")).alias("est_longitude")), "seg").alias("e")).select("id", "e.*")
    return pairs.join(found, "id", "left")
