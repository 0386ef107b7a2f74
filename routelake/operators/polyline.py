"""Sequences of vertices (rec, pos, lon, lat, ele) as windows over rec in order of pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from routelake.functions.geo import DEGREE_M, haversine_m, point_code


def line() -> WindowSpec:
    return Window.partitionBy("rec").orderBy("pos")


def before() -> WindowSpec:
    return line().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rest() -> WindowSpec:
    return line().rowsBetween(Window.currentRow, Window.unboundedFollowing)


def whole() -> WindowSpec:
    return Window.partitionBy("rec")


def with_segments(vertices: DataFrame) -> DataFrame:
    """Adds seg_m, metres to the next vertex, null at the last."""
    return vertices.withColumn("seg_m", haversine_m(F.col("lon"), F.col("lat"), F.lead("lon").over(line()), F.lead("lat").over(line())))


def with_arc(vertices: DataFrame) -> DataFrame:
    """Adds seg_m, at_m (metres from the start) and total_m."""
    out = with_segments(vertices)
    return out.withColumns({"at_m": F.coalesce(F.sum("seg_m").over(before()), F.lit(0.0)), "total_m": F.coalesce(F.sum("seg_m").over(whole()), F.lit(0.0))})


def filled(vertices: DataFrame) -> DataFrame:
    """ele carried forward, then backward; 0 where a line has none at all."""
    return vertices.withColumn("ele", F.coalesce(F.last("ele", ignorenulls=True).over(so_far()), F.first("ele", ignorenulls=True).over(rest()), F.lit(0.0)))


def ascent_descent(vertices: DataFrame) -> DataFrame:
    """(rec, ascent_m, descent_m): sums of rises and falls between neighbours."""
    step = F.col("ele") - F.lag("ele").over(line())
    out = vertices.withColumn("step_", step)
    return out.groupBy("rec").agg(F.coalesce(F.sum(F.greatest(F.col("step_"), F.lit(0.0))), F.lit(0.0)).alias("ascent_m"), F.coalesce(F.sum(F.greatest(-F.col("step_"), F.lit(0.0))), F.lit(0.0)).alias("descent_m"))


def worst_gaps(vertices: DataFrame) -> DataFrame:
    """(rec, n_points, max_gap_m, gap_at): the longest segment, the first of equals."""
    out = with_segments(vertices)
    worst = F.max(F.when(F.col("seg_m").isNotNull(), F.struct("seg_m", (-F.col("pos")).alias("back"))))
    return out.groupBy("rec").agg(F.count("*").alias("n_points"), worst.alias("w")).where("w IS NOT NULL").select("rec", "n_points", F.col("w.seg_m").alias("max_gap_m"), (-F.col("w.back")).alias("gap_at"))


def at_fractions(vertices: DataFrame, fractions: list[float]) -> DataFrame:
    """(rec, fraction, lon, lat): points at fractions of the arc length; a line without length gives its first vertex."""
    arc = with_arc(vertices).withColumns({"lon2": F.lead("lon").over(line()), "lat2": F.lead("lat").over(line())})
    each = arc.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("target", F.col("fraction") * F.col("total_m"))
    inside = (F.col("at_m") <= F.col("target")) & (F.col("seg_m").isNull() | (F.col("target") < F.col("at_m") + F.col("seg_m")))
    point = each.where(inside | ((F.col("total_m") == 0) & (F.col("pos") == 0)))
    t = F.when(F.col("seg_m") > 0, (F.col("target") - F.col("at_m")) / F.col("seg_m")).otherwise(0.0)
    point = point.withColumns({"x": F.col("lon") + F.coalesce((F.col("lon2") - F.col("lon")) * t, F.lit(0.0)), "y": F.col("lat") + F.coalesce((F.col("lat2") - F.col("lat")) * t, F.lit(0.0))})
    return point.groupBy("rec", "fraction").agg(F.min_by(F.struct("x", "y"), "pos").alias("p")).select("rec", "fraction", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def resampled(vertices: DataFrame, n: int) -> DataFrame:
    """(rec, i, ele): n evenly spaced heights along each line of two vertices or more, by linear interpolation, to 0.1 m."""
    arc = with_arc(vertices).withColumns({"ele2": F.lead("ele").over(line()), "last_": F.max("pos").over(whole())})
    # A segment answers for the targets that fall on it, so targets are made where they are needed, not joined.
    segment = arc.where(F.col("seg_m").isNotNull())
    step = F.col("total_m") / (n - 1)
    lo = F.when(F.col("total_m") > 0, F.ceil(F.col("at_m") / step)).otherwise(0)
    hi = F.when(F.col("total_m") > 0, F.ceil((F.col("at_m") + F.col("seg_m")) / step) - 1).otherwise(n - 1)
    lo = F.greatest(lo - 1, F.lit(0))
    hi = F.least(hi + 1, F.lit(n - 1))
    each = segment.where((F.col("total_m") > 0) | (F.col("pos") == 0)).withColumn("i", F.explode(F.sequence(lo.cast("int"), hi.cast("int")))).withColumn("target", F.col("i") * step)
    final = F.col("pos") + 1 == F.col("last_")
    inside = (F.col("target") >= F.col("at_m")) & ((F.col("target") < F.col("at_m") + F.col("seg_m")) | final)
    each = each.where(inside | (F.col("total_m") == 0))
    t = F.when(F.col("seg_m") > 0, F.least((F.col("target") - F.col("at_m")) / F.col("seg_m"), F.lit(1.0))).otherwise(0.0)
    value = F.col("ele") + (F.col("ele2") - F.col("ele")) * t
    return each.withColumn("value_", F.round(value, 1)).groupBy("rec", "i").agg(F.min_by("value_", "pos").alias("ele"))


def smoothed(vertices: DataFrame, kernel_m: float) -> DataFrame:
    """ele as a mean of the line's vertices with triangular weights over half the kernel's width. A frame over metres keeps the pairs within reach."""
    half = kernel_m / 2
    arc = with_arc(vertices)
    # The frame runs over whole millimetres, as range frames of sliding sums need a number type without rounding.
    mm = (F.col("at_m") * 1000).cast("long")
    reach = Window.partitionBy("rec").orderBy("mm_").rangeBetween(-int(half * 1000) - 1, int(half * 1000) + 1)
    near = arc.withColumn("mm_", mm).withColumn("near_", F.collect_list(F.struct("at_m", "ele")).over(reach))
    weight = lambda x: F.greatest(1 - F.abs(x["at_m"] - F.col("at_m")) / half, F.lit(0.0))
    sums = F.aggregate("near_", F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v")), lambda a, x: F.struct((a["w"] + weight(x)).alias("w"), (a["v"] + weight(x) * x["ele"]).alias("v")))
    return near.withColumn("s_", sums).withColumn("ele", F.col("s_.v") / F.col("s_.w")).drop("near_", "mm_", "s_")


def merged_segments(lines: DataFrame, least_m: float) -> DataFrame:
    """segs array<struct<len, dz>> of lines with neighbours merged until each run is at least least_m; a short rest stays."""
    start = F.struct(F.expr("CAST(array() AS array<struct<len: double, dz: double>>)").alias("out"), F.lit(0.0).alias("len"), F.lit(0.0).alias("dz"))

    def step(a, x):
        long, rise = a["len"] + x["len"], a["dz"] + x["dz"]
        done = long >= least_m
        return F.struct(F.when(done, F.concat(a["out"], F.array(F.struct(long.alias("len"), rise.alias("dz"))))).otherwise(a["out"]).alias("out"), F.when(done, 0.0).otherwise(long).alias("len"), F.when(done, 0.0).otherwise(rise).alias("dz"))

    finish = lambda a: F.when(a["len"] > 0, F.concat(a["out"], F.array(F.struct(a["len"].alias("len"), a["dz"].alias("dz"))))).otherwise(a["out"])
    return lines.withColumn("segs", F.aggregate("segs", start, step, finish))


def retrace(vertices: DataFrame, cell_m: float = 5.0) -> DataFrame:
    """(rec, n_points, worst_m): the largest way along the line between two vertices of one small cell."""
    arc = with_arc(vertices).withColumn("lat0", F.avg("lat").over(whole()))
    x = F.rint(F.col("lon") * DEGREE_M * F.greatest(F.cos(F.radians("lat0")), F.lit(1e-6)) / cell_m)
    cells = arc.withColumns({"cx": x.cast("long"), "cy": F.rint(F.col("lat") * DEGREE_M / cell_m).cast("long")})
    spans = cells.groupBy("rec", "cx", "cy").agg((F.max("at_m") - F.min("at_m")).alias("span"), F.count("*").alias("n"))
    return spans.groupBy("rec").agg(F.sum("n").alias("n_points"), F.max("span").alias("worst_m"))


def ends(vertices: DataFrame) -> DataFrame:
    """(rec, n_points, total_m, straightness): distance of the ends over the length, null without length."""
    arc = with_arc(vertices)
    first, last = F.min_by(F.struct("lon", "lat"), "pos"), F.max_by(F.struct("lon", "lat"), "pos")
    out = arc.groupBy("rec").agg(F.count("*").alias("n_points"), F.max("total_m").alias("total_m"), first.alias("a"), last.alias("b"))
    direct: Column = haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    return out.select("rec", "n_points", "total_m", F.try_divide(direct, F.col("total_m")).alias("straightness"))


def split_at(lines: DataFrame) -> DataFrame:
    """Two halves of each edge (edge_id, length_m, ascent_m, descent_m, points) at segment seg, fraction t and arc share f: points, and the numbers in proportion."""
    cut = F.struct((F.col("points")[F.col("seg")]["lon"] + (F.col("points")[F.col("seg") + 1]["lon"] - F.col("points")[F.col("seg")]["lon"]) * F.col("t")).alias("lon"), (F.col("points")[F.col("seg")]["lat"] + (F.col("points")[F.col("seg") + 1]["lat"] - F.col("points")[F.col("seg")]["lat"]) * F.col("t")).alias("lat"))
    head = F.concat(F.slice("points", F.lit(1), F.col("seg") + 1), F.array(cut))
    tail = F.concat(F.array(cut), F.slice("points", F.col("seg") + 2, F.size("points")))
    half = lambda k, share, points: F.struct((F.col("edge_id") * 3 + k).alias("half_id"), (F.col("length_m") * share).alias("length_m"), (F.col("ascent_m") * share).alias("ascent_m"), (F.col("descent_m") * share).alias("descent_m"), points.alias("points"))
    return lines.select("edge_id", F.explode(F.array(half(1, F.col("f"), head), half(2, 1 - F.col("f"), tail))).alias("h")).select("edge_id", "h.*")


def with_elevations(vertices: DataFrame, known: DataFrame) -> DataFrame:
    """Vertices (rec, pos, lon, lat) with ele of known (lon, lat, ele, ord) at the same place to 1e-7 degrees, the first of several; null where none is."""
    x, y = point_code(F.col("lon"), F.col("lat"))
    lookup = known.select(x.alias("kx"), y.alias("ky"), "ele", "ord").groupBy("kx", "ky").agg(F.min_by("ele", "ord").alias("ele"))
    return vertices.drop("ele").withColumns({"kx": x, "ky": y}).join(lookup, ["kx", "ky"], "left").drop("kx", "ky")


def leg_at(legs: DataFrame, kilometres: DataFrame) -> DataFrame:
    """(trip_id, km, leg, fraction): the leg of legs (trip_id, leg, distance_m) at each of kilometres (trip_id, km)."""
    walk = Window.partitionBy("trip_id").orderBy("leg")
    rows = legs.withColumn("end_m", F.sum("distance_m").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("last", F.max("leg").over(Window.partitionBy("trip_id")))
    m = F.col("km") * 1000
    start = F.col("end_m") - F.col("distance_m")
    joined = kilometres.join(rows, "trip_id").where((m >= start) & ((m < F.col("end_m")) | (F.col("leg") == F.col("last"))))
    return joined.select("trip_id", "km", "leg", F.when(F.col("distance_m") > 0, F.least((m - start) / F.col("distance_m"), F.lit(1.0))).otherwise(0.0).alias("fraction"))
