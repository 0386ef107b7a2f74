"""What a map shows of tours: clusters, anchors, boards, elevation along a trip, signpost places."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.geo import mercator_tile
from routelake.functions.text import kilometres, metres, signpost_time

#: Pixels of a cluster, of a board, its mast and the mast's half width, and around boards and dots.
CLUSTER_PX, LAST_ZOOM, BOARD_H, MAST_H, MAST_HALF, MARGIN, CLEARANCE = 60, 14, 26.0, 24.0, 1.0, 4.0, 8.0


def clusters(points: DataFrame, zooms: list[int]) -> DataFrame:
    """(zoom, x, y, n, lon, lat) of points (lon, lat) by squares of the web map at each zoom; a plain grid, not a nearest-first merge."""
    each = points.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    x, y = mercator_tile(F.col("lon"), F.col("lat"), F.least(F.col("zoom"), F.lit(LAST_ZOOM)), CLUSTER_PX)
    return each.groupBy("zoom", x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def bubble_radius(n: Column) -> Column:
    return F.least(F.lit(34.0), F.greatest(F.lit(12.0), 9 + 3.5 * F.sqrt(n)))


def waypoints(tours: DataFrame, places: DataFrame) -> DataFrame:
    """(tour_id, points array<struct<lon, lat>>): places of start, huts and exit of tours (tour_id, start_id, huts, exit_start_id); places has (kind start or hut, id, lon, lat). A tour with a place missing is left out."""
    stop = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("id"))
    stops = F.concat(F.array(stop("start", F.col("start_id"))), F.transform("huts", lambda h: stop("hut", h)), F.array(stop("start", F.col("exit_start_id"))))
    each = tours.select("tour_id", F.posexplode(stops).alias("pos", "s")).select("tour_id", "pos", "s.*").join(places, ["kind", "id"], "left")
    grouped = each.groupBy("tour_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"), F.bool_and(F.col("lon").isNotNull()).alias("whole"))
    return grouped.where("whole").select("tour_id", F.transform("p", lambda x: F.struct(x["lon"], x["lat"])).alias("points"))


def anchors(legs: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(tour_id, lon, lat, heading, rank) of anchors in a box, those nearest half way first, ties in walking order. legs: (tour_id, leg, distance_m, reversed, anchors array<struct<lon, lat>> or null, from_lon, from_lat, to_lon, to_lat); a leg without anchors gives points on its chord."""
    fractions = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    chord = F.transform(fractions, lambda t: F.struct((F.col("from_lon") + (F.col("to_lon") - F.col("from_lon")) * t).alias("lon"), (F.col("from_lat") + (F.col("to_lat") - F.col("from_lat")) * t).alias("lat")))
    shipped = F.when(F.col("reversed"), F.reverse("anchors")).otherwise(F.col("anchors"))
    walk = Window.partitionBy("tour_id").orderBy("leg")
    rows = legs.withColumn("pts", F.coalesce(shipped, chord)).withColumns({"walked": F.coalesce(F.sum("distance_m").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "half": F.sum("distance_m").over(Window.partitionBy("tour_id")) / 2})
    before = lambda i: F.when(i == 0, F.col("from_lon")).otherwise(F.get("pts", i - 1)["lon"])
    after = lambda i: F.coalesce(F.get("pts", i + 1)["lon"], F.col("to_lon"))
    marked = F.transform("pts", lambda p, i: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), (F.col("walked") + (i + 1) / (F.size("pts") + 1) * F.col("distance_m")).alias("at"), F.when(after(i) < before(i), "west").otherwise("east").alias("heading")))
    each = rows.select("tour_id", "leg", "half", F.posexplode(marked).alias("k", "p")).select("tour_id", "leg", "half", "k", "p.*")
    inside = each.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    order = Window.partitionBy("tour_id").orderBy(F.abs(F.col("at") - F.col("half")), "leg", "k")
    return inside.withColumn("rank", F.row_number().over(order)).select("tour_id", "lon", "lat", "heading", "rank")


def boards(tours: DataFrame, names: DataFrame) -> DataFrame:
    """(tour_id, text, detail, round_trip, title) of tours with totals; names has (start_id, name)."""
    a, b = names.select("start_id", F.col("name").alias("a")), names.select(F.col("start_id").alias("exit_start_id"), F.col("name").alias("b"))
    rows = tours.join(a, "start_id", "left").join(b, "exit_start_id", "left")
    loop = F.col("start_id") == F.col("exit_start_id")
    route = F.when(loop, F.concat(F.lit("Rundtour ab "), "a")).otherwise(F.concat("a", F.lit(" → "), "b"))
    far, up = kilometres(F.col("total_distance_m")), F.concat(F.lit("↑ "), metres(F.col("total_ascent_m")))
    return rows.select("tour_id", far.alias("text"), up.alias("detail"), loop.alias("round_trip"), F.concat_ws(" · ", route, far, up, signpost_time(F.col("total_h"))).alias("title"))


def as_trips(tours: DataFrame, starts: DataFrame, huts: DataFrame, day: str | None, party: int) -> DataFrame:
    """Trips of tours whose start and exit are known: named after the first and last hut ('?' if unknown)."""
    a, b = starts.select("start_id", F.col("start_type").alias("start_type")), starts.select(F.col("start_id").alias("exit_start_id"))
    h1, h2 = huts.select(F.col("hut_id").alias("first"), F.col("name").alias("n1")), huts.select(F.col("hut_id").alias("last"), F.col("name").alias("n2"))
    rows = tours.withColumns({"first": F.element_at("huts", 1), "last": F.element_at("huts", -1)}).join(a, "start_id").join(b, "exit_start_id").join(h1, "first", "left").join(h2, "last", "left")
    name = F.concat(F.coalesce("n1", F.lit("?")), F.lit(" – "), F.coalesce("n2", F.lit("?")))
    return rows.select("tour_id", name.alias("name"), "start_type", "start_id", F.col("exit_start_id").alias("exit_id"), "huts", F.lit(day).cast("string").alias("date"), F.lit(party).alias("party"))


def trip_elevation(legs: DataFrame) -> DataFrame:
    """(trip_id, leg, i, km, ele): samples of legs (trip_id, leg, distance_m, reversed, profile) end to end, evenly spread over each leg."""
    walk = Window.partitionBy("trip_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    rows = legs.withColumn("start_m", F.coalesce(F.sum("distance_m").over(walk), F.lit(0.0))).withColumn("profile", F.when(F.col("reversed"), F.reverse("profile")).otherwise(F.col("profile")))
    each = rows.select("trip_id", "leg", "start_m", "distance_m", F.size("profile").alias("n"), F.posexplode("profile").alias("i", "ele"))
    share = F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    return each.select("trip_id", "leg", "i", ((F.col("start_m") + share * F.col("distance_m")) / 1000).alias("km"), "ele")


def tile_stats(records: DataFrame, tags: DataFrame) -> DataFrame:
    """(edge_id, stats): JSON of an edge's numbers, sentinels as nulls, with its start's access; tags has (start_id, access)."""
    clean = lambda c, s: F.nullif(F.col(c), F.lit(s)).alias(c)
    rows = records.join(tags, "start_id", "left")
    return rows.select("edge_id", F.to_json(F.struct("distance_m", "ascent_m", "descent_m", clean("max_ele_m", -1.0), clean("sac_rank", -1), "access")).alias("stats"))


def signposts(tours: DataFrame, viewport: tuple[float, float], previous: DataFrame | None = None) -> DataFrame:
    """(view, key, kind, x, y, side): boards that do not overlap, in rank order, sticky to where they stood, else dots. tours: (view, rank, key, width, spots array<struct<x, y, east>>) in pixels. Each choice depends on those before it, so it is a fold over a view."""
    out = "view int, key string, kind string, x double, y double, side string"
    joined = tours if previous is None else tours.join(previous.select("view", "key", F.struct("kind", "x", "y", "side").alias("prev")), ["view", "key"], "left")
    wide, high = viewport

    def box(x: float, y: float, side: str, width: float) -> tuple[float, float, float, float]:
        """(left, top, right, bottom) of a board on its mast; its tail stands at the mast's outer edge."""
        left = x - MAST_HALF if side == "right" else x + MAST_HALF - width
        return left, y - MAST_H - BOARD_H, left + width, y

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        boxes, feet, placed, dots, waiting = [], [], [], [], []
        free = lambda b: all(b[2] + MARGIN <= o[0] or o[2] + MARGIN <= b[0] or b[3] + MARGIN <= o[1] or o[3] + MARGIN <= b[1] for o in boxes)

        def put(r, x, y, side) -> bool:
            b = box(x, y, side, r.width)
            if not free(b):
                return False
            boxes.append(b)
            feet.append((x, y))
            placed.append((r.view, r.key, "board", x, y, side))
            return True

        side_of = lambda s: "right" if s["east"] else "left"
        for r in rows.sort_values("rank").itertuples():
            prev = getattr(r, "prev", None)
            spots = list(r.spots)
            at = next((s for s in spots if prev and (s["x"], s["y"]) == (prev["x"], prev["y"])), None)
            if at is not None and prev["kind"] == "board" and 0 <= at["x"] <= wide and 0 <= at["y"] <= high:
                if not put(r, at["x"], at["y"], prev["side"]):
                    feet.append((at["x"], at["y"]))
                    dots.append((r.view, r.key, "dot", at["x"], at["y"], side_of(at)))
            elif spots:
                waiting.append((r, [at, *(s for s in spots if s is not at)] if at is not None else spots))
        late = []
        for r, spots in waiting:
            for s in spots:
                sides = (side_of(s), "left" if side_of(s) == "right" else "right")
                fits = [d for d in sides if (b := box(s["x"], s["y"], d, r.width))[0] >= 0 and b[1] >= 0 and b[2] <= wide and b[3] <= high]
                if any(put(r, s["x"], s["y"], d) for d in fits):
                    break
            else:
                late.append((r, spots))
        for r, spots in late:
            s = next((s for s in spots if all(math.hypot(s["x"] - x, s["y"] - y) >= CLEARANCE for x, y in feet)), spots[0])
            feet.append((s["x"], s["y"]))
            dots.append((r.view, r.key, "dot", s["x"], s["y"], side_of(s)))
        return pd.DataFrame([*placed, *dots], columns=[c.split()[0] for c in out.split(", ")])

    return joined.groupBy("view").applyInPandas(fold, out)


def emphasis(key: Column, hovered: Column, focused: Column) -> Column:
    return F.when(key == hovered, "hovered").when(key == focused, "focused").otherwise("rest")


def centroid(ring: Column) -> Column:
    """Centre of a closed ring array<struct<lon, lat>> by the shoelace rule."""
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct((a["lon"] * b["lat"] - b["lon"] * a["lat"]).alias("w"), (a["lon"] + b["lon"]).alias("x"), (a["lat"] + b["lat"]).alias("y")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    area = total(lambda p: p["w"]) * 3
    return F.struct((total(lambda p: p["w"] * p["x"]) / area).alias("lon"), (total(lambda p: p["w"] * p["y"]) / area).alias("lat"))
