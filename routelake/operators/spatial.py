"""Distance joins without cross joins: points meet in cells of a grid as wide as the radius, then the true distance decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.geo import DEGREE_M, EARTH_M, haversine_m, metres, nearest_on_segment


def _cells(radius_m: float, lat_most: float) -> tuple[float, float]:
    """Degrees of a cell that no pair within the radius can skip, up to a latitude."""
    return radius_m / DEGREE_M * 1.001, radius_m / DEGREE_M / math.cos(math.radians(lat_most)) * 1.001


def _angles(lon: str, lat: str) -> dict[str, Column]:
    """What the distance takes of one point, computed once a point and not once a pair."""
    return {f"{lat}_p_": F.radians(lat), f"{lat}_c_": F.cos(F.radians(lat)), f"{lon}_l_": F.radians(lon)}


def bucket_join(left: DataFrame, right: DataFrame, radius_m: float, how: str = "inner", lat_most: float = 60.0, on: Column | None = None, copy: str = "left", fine: int = 1) -> DataFrame:
    """Pairs of left (lon, lat) and right (lon2, lat2) within radius_m, with distance_m. The side named by copy goes to the cells around its own, so it should be the smaller one; cells are as wide as the radius divided by fine; points lie south of lat_most.

    Both sides are dealt by cell: the size of a side that is copied is not known beforehand, and pairs outgrow any side. Squares in the plane settle all pairs but those within a hair of the radius, without a sine."""
    step_lat, step_lon = (x / fine for x in _cells(radius_m, lat_most))
    at = lambda lon, lat, i=0, j=0: F.struct((F.floor(F.col(lon) / step_lon) + i).alias("cx"), (F.floor(F.col(lat) / step_lat) + j).alias("cy"))
    around = lambda lon, lat: F.explode(F.array(*[at(lon, lat, i, j) for i in range(-fine, fine + 1) for j in range(-fine, fine + 1)]))
    a = left.withColumns(_angles("lon", "lat")).withColumn("cell_", around("lon", "lat") if copy == "left" else at("lon", "lat"))
    b = right.withColumns(_angles("lon2", "lat2")).withColumn("cell_", around("lon2", "lat2") if copy == "right" else at("lon2", "lat2"))
    a, b = (x.select("*", "cell_.cx", "cell_.cy").drop("cell_") for x in (a, b))
    cosines = F.col("lat_c_") * F.col("lat2_c_")
    half = F.pow(F.sin((F.col("lat2_p_") - F.col("lat_p_")) / 2), F.lit(2)) + cosines * F.pow(F.sin(F.radians(F.col("lon2") - F.col("lon")) / 2), F.lit(2))
    distance = 2 * EARTH_M * F.asin(F.least(F.sqrt(half), F.lit(1.0)))
    # A sine is below its angle x by x**3 / 6 at most, so the plane's square is never below the chord's, and above it by less than this part.
    dy, dx = F.col("lat2_p_") - F.col("lat_p_"), F.col("lon2_l_") - F.col("lon_l_")
    plane, most = dy * dy + cosines * dx * dx, 4 * math.sin(min(radius_m / EARTH_M, math.pi) / 2) ** 2
    slack = 1e-9 + (radius_m / EARTH_M / math.cos(math.radians(lat_most))) ** 2
    joined = a.join(b.hint("merge"), ["cx", "cy"])
    if on is not None:
        joined = joined.where(on)
    joined = joined.where((plane <= most * (1 - 1e-9)) | ((plane <= most * (1 + slack)) & (distance <= radius_m)))
    return joined.withColumn("distance_m", distance).drop("cx", "cy", *_angles("lon", "lat"), *_angles("lon2", "lat2"))


def within_range(points: DataFrame, huts: DataFrame, radius_m: float) -> DataFrame:
    """Points (lon, lat) that have a hut (lon2, lat2) within the radius: a semi join."""
    step_lat, step_lon = _cells(radius_m, 60.0)
    near = F.array(*[F.struct((F.floor(F.col("lon2") / step_lon) + i).alias("cx"), (F.floor(F.col("lat2") / step_lat) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = huts.select("lon2", "lat2", F.explode(near).alias("c")).select("lon2", "lat2", F.col("c.cx").alias("bx"), F.col("c.cy").alias("by"))
    a = points.withColumns({"cx": F.floor(F.col("lon") / step_lon), "cy": F.floor(F.col("lat") / step_lat)})
    test = (F.col("cx") == F.col("bx")) & (F.col("cy") == F.col("by")) & (haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) <= radius_m)
    return a.join(b, test, "left_semi").drop("cx", "cy")


def _first_radius(others: DataFrame, radius_m: float) -> float:
    """A radius at most the given one that holds some eight of the others (lon2, lat2) where they lie evenly over their box."""
    n, *box = others.agg(F.count("lon2"), F.min("lon2"), F.max("lon2"), F.min("lat2"), F.max("lat2")).first()
    if not n:
        return radius_m
    west, east, south, north = box
    area = max((east - west) * math.cos(math.radians(south)) * (north - south) * DEGREE_M**2, 1.0)
    found = max(math.sqrt(8 * area / n / math.pi), radius_m / 1024)
    return found if found < radius_m / 2 else radius_m


def nearest(points: DataFrame, others: DataFrame, radius_m: float, key: list[str], ties: list[str], copy: str = "left") -> DataFrame:
    """The nearest of the others (lon2, lat2, …) within the radius of each point (key, lon, lat), with distance_m; of equally near ones the first by ties. Points that find one near by are done, the rest look four times as far, up to the radius."""
    from routelake.plans.lineage import cut

    reach, done = _first_radius(others, radius_m), None
    while True:
        found = bucket_join(points, others, reach, copy=copy)
        rest = [c for c in found.columns if c not in key]
        found = found.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("distance_m", *ties)).alias("m_")).select(*key, "m_.*")
        if reach >= radius_m:
            return found if done is None else done.unionByName(found)
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        points = cut(points.join(found.select(*key), key, "left_anti"))
        reach = radius_m if reach * 8 > radius_m else reach * 4


def nearest_edge_points(hubs: DataFrame, segments: DataFrame, radius_m: float, sample_m: float = 50.0) -> DataFrame:
    """(hub_type, hub_id, edge_id, seg, t, gap_m): the nearest point of every segment (edge_id, seg, lon_a, lat_a, lon_b, lat_b) near a hub (hub_type, hub_id, lon, lat), best first by hub. Segments are found by samples along them."""
    length = haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    steps = F.greatest(F.ceil(length / sample_m), F.lit(1)).cast("int")
    samples = segments.withColumn("n_", steps).withColumn("k_", F.explode(F.sequence(F.lit(0), F.col("n_"))))
    samples = samples.withColumns({"lon2": F.col("lon_a") + (F.col("lon_b") - F.col("lon_a")) * F.col("k_") / F.col("n_"), "lat2": F.col("lat_a") + (F.col("lat_b") - F.col("lat_a")) * F.col("k_") / F.col("n_")})
    near = bucket_join(hubs, samples.drop("n_", "k_"), radius_m + sample_m).select("hub_type", "hub_id", "lon", "lat", "edge_id", "seg", "lon_a", "lat_a", "lon_b", "lat_b").distinct()
    ax, ay = metres(F.col("lon_a"), F.col("lat_a"), F.col("lon"), F.col("lat"))
    bx, by = metres(F.col("lon_b"), F.col("lat_b"), F.col("lon"), F.col("lat"))
    t, d2 = nearest_on_segment(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
    out = near.withColumns({"t": t, "gap_m": F.sqrt(d2)}).where(F.col("gap_m") <= radius_m)
    first = Window.partitionBy("hub_type", "hub_id").orderBy("gap_m", "edge_id", "seg")
    return out.withColumn("rank", F.row_number().over(first)).select("hub_type", "hub_id", "edge_id", "seg", "t", "gap_m", "rank")


def snap(hubs: DataFrame, nodes: DataFrame, segments: DataFrame, radius_m: float = 100.0, rise_m: float = 25.0, slack_m: float = 1.0) -> DataFrame:
    """Hubs (hub_type, hub_id, lon, lat, ele) on nodes (node_id, lon2, lat2, ele2) or segments (with ele_a, ele_b): kind node, edge or rejected, with gap, vertical gap and reason; an unknown height rejects nothing. A node wins over an edge that is less than slack_m nearer."""
    node = nearest(hubs, nodes, radius_m, ["hub_type", "hub_id"], ["node_id"]).select("hub_type", "hub_id", "node_id", F.col("distance_m").alias("node_gap"), F.col("ele2").alias("node_ele"))
    edge = nearest_edge_points(hubs, segments, radius_m).where("rank = 1").drop("rank")
    edge = edge.join(segments.select("edge_id", "seg", "ele_a", "ele_b"), ["edge_id", "seg"]).withColumn("edge_ele", F.col("ele_a") + (F.col("ele_b") - F.col("ele_a")) * F.col("t")).drop("ele_a", "ele_b")
    out = hubs.join(node, ["hub_type", "hub_id"], "left").join(edge, ["hub_type", "hub_id"], "left")
    use_node = F.col("node_gap").isNotNull() & (F.col("gap_m").isNull() | (F.col("node_gap") <= F.col("gap_m") + slack_m))
    out = out.withColumns({"target": F.when(use_node, "node").when(F.col("gap_m").isNotNull(), "edge"), "gap": F.when(use_node, F.col("node_gap")).otherwise(F.col("gap_m"))})
    out = out.withColumn("dz_m", F.when(F.col("target") == "node", F.col("node_ele")).otherwise(F.col("edge_ele")) - F.col("ele"))
    reason = F.when(F.col("target").isNull(), "gap_too_far").when(F.abs("dz_m") > rise_m, "vertical_offset")
    out = out.withColumn("reason", reason)
    return out.select("hub_type", "hub_id", F.when(F.col("reason").isNull(), F.col("target")).otherwise("rejected").alias("kind"), "node_id", "edge_id", "seg", "t", F.col("gap").alias("gap_m"), "dz_m", "reason")


def stops_once(stops: DataFrame, radius_m: float = 40.0, lat_most: float = 60.0) -> DataFrame:
    """Stops (id, name, is_position, lon, lat) without the stop positions that lie within the radius of a kept stop of the same name, unnamed ones being alike. All others are kept; of positions the least id is. The rule is greedy by id, so it is settled in rounds: of the undecided, those without a lesser undecided neighbour stay, and their neighbours go."""
    from routelake.plans.lineage import cut

    other = stops.select(F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("is_position").alias("position2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    position = stops.where("is_position")
    lesser = (F.col("id2") < F.col("id")) | ~F.col("position2")
    links = cut(bucket_join(position, other, radius_m, lat_most=lat_most, on=F.col("name").eqNullSafe(F.col("name2")) & lesser).select("id", "id2", "position2"))
    gone = links.where("NOT position2").select("id").distinct()
    links = links.where("position2").select("id", "id2")
    open_ = cut(position.select("id").join(gone, "id", "left_anti"))
    gone = cut(gone)
    while not open_.isEmpty():
        among = links.join(open_, "id", "left_semi").join(open_.withColumnRenamed("id", "id2"), "id2", "left_semi")
        stay = cut(open_.join(among.select("id").distinct(), "id", "left_anti"))
        hit = cut(among.join(stay.withColumnRenamed("id", "id2"), "id2", "left_semi").select("id").distinct())
        gone = gone.unionByName(hit)
        open_ = cut(open_.join(stay, "id", "left_anti").join(hit, "id", "left_anti"))
    return stops.join(gone, "id", "left_anti").select(*stops.columns)


def raster_samples(points: DataFrame, raster: DataFrame, lon0: float, lat0: float, step: float) -> DataFrame:
    """Bilinear value at points (id, lon, lat) of raster (row, col, value) whose pixel centres start at (lon0, lat0): four equi joins folded into one."""
    x, y = (F.col("lon") - lon0) / step, (F.col("lat") - lat0) / step
    at = points.withColumns({"col0": F.floor(x), "row0": F.floor(y), "fx": x - F.floor(x), "fy": y - F.floor(y)})
    corners = F.array(*[F.struct((F.col("row0") + j).alias("row"), (F.col("col0") + i).alias("col"), ((F.col("fx") if i else 1 - F.col("fx")) * (F.col("fy") if j else 1 - F.col("fy"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    each = at.select("id", F.explode(corners).alias("c")).select("id", "c.row", "c.col", "c.w")
    joined = each.join(raster, ["row", "col"], "left")
    value = F.when(F.count_if((F.col("w") > 0) & F.col("value").isNull()) == 0, F.sum(F.when(F.col("w") > 0, F.col("w") * F.col("value")).otherwise(0.0)))
    return joined.groupBy("id").agg(value.alias("value"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """One value a pixel of tiles (priority, row, col, value): that of the last source that has one."""
    return tiles.where("value IS NOT NULL").groupBy("row", "col").agg(F.max_by("value", "priority").alias("value"))


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on points array<struct<lon, lat>> of lines (id, points); lines of two points or fewer pass."""
    import numpy as np

    def keep(points: list) -> list:
        if points is None or len(points) <= 2:
            return points
        xy = np.array([(p["lon"], p["lat"]) for p in points])
        used, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            base, between = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
            long2 = (base**2).sum()
            t = np.clip(between @ base / long2, 0, 1)[:, None] if long2 else np.zeros((len(between), 1))
            gap = ((between - t * base) ** 2).sum(1)
            worst = int(gap.argmax())
            if gap[worst] > tolerance**2:
                used.add(a + 1 + worst)
                todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
        return [points[k] for k in sorted(used)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(points=[keep(list(p) if p is not None else None) for p in rows["points"]])

    return lines.mapInPandas(run, lines.schema)


def trails(ways: DataFrame, points: DataFrame, rings: DataFrame, highways: list[str]) -> DataFrame:
    """Ways (way_id, highway) of the given kinds that have a point (way_id, pos, lon, lat) inside a region's rings, whole, each once though regions overlap."""
    from routelake.operators.quality import inside

    wanted = ways.where(F.col("highway").isin(*highways))
    at = points.join(wanted.select("way_id"), "way_id", "left_semi").withColumn("pid", F.struct("way_id", "pos"))
    return wanted.join(inside(at, rings).select("way_id").distinct(), "way_id", "left_semi").dropDuplicates(["way_id"])
