"""Legs: directions, durations, filters, adjacency, and the approach tables made of start edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.walking import leg_hours
from routelake.schema import FAST_ANY

BUCKETS_H, BEST = (4.0, 6.0), 20


def hours() -> Column:
    return leg_hours(F.col("distance_m"), F.col("ascent_m"), F.col("descent_m"))


def forward(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"reversed": F.lit(False), "duration_h": hours()})


def backward(edges: DataFrame, ends: tuple[str, str] = ("from_id", "to_id")) -> DataFrame:
    """The same edges walked the other way: ends and climbs swap, the duration is computed anew."""
    swaps = {"ascent_m": F.col("descent_m"), "descent_m": F.col("ascent_m")}
    if ends[0] in edges.columns:
        swaps |= {ends[0]: F.col(ends[1]), ends[1]: F.col(ends[0])}
    return edges.withColumns(swaps).withColumns({"reversed": F.lit(True), "duration_h": hours()})


def adjacency(edges: DataFrame) -> DataFrame:
    """Directed legs of undirected edges, both ways; ord keeps the order of records, forward before backward."""
    ordered = edges.withColumn("ord", F.col("ord") * 2) if "ord" in edges.columns else edges.withColumn("ord", F.col("edge_id") * 2)
    return forward(ordered).unionByName(backward(ordered).withColumn("ord", F.col("ord") + 1))


def kill_reason(max_h: float, min_h: float = 0.0, ascent_cap: float | None = None, max_ele: float | None = None, ferrata: bool = True) -> Column:
    """The first constraint that a leg breaks, null if it passes. An unknown greatest height passes."""
    out = F.when(F.col("duration_h") > max_h, "max_leg_time").when(F.col("duration_h") < min_h, "min_leg_time")
    if ascent_cap is not None:
        out = out.when(F.col("ascent_m") > ascent_cap, "leg_ascent_cap")
    if max_ele is not None:
        out = out.when(F.coalesce(F.col("max_ele_m") > max_ele, F.lit(False)), "max_ele")
    if not ferrata:
        out = out.when(F.coalesce(F.col("via_ferrata"), F.lit(False)), "via_ferrata")
    return out


def bucket(duration: Column, bounds: tuple[float, ...] = BUCKETS_H) -> Column:
    """Number of the duration's bucket; a bound belongs to the bucket below it."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: duration > b))


def approach_matrix(starts: DataFrame, variants: tuple[int, ...] = (FAST_ANY,), bounds: tuple[float, ...] = BUCKETS_H) -> DataFrame:
    """The fastest start edge of each (hut, start type, variant, duration bucket), the first edge of equals. Adds duration_h, bucket and access_unknown."""
    rows = starts.where(F.col("variant").isin(*variants)).withColumn("duration_h", hours()).withColumn("bucket", bucket(F.col("duration_h"), bounds)).withColumn("access_unknown", F.col("access").isNull())
    cell = Window.partitionBy("hut_id", "start_type", "variant", "bucket").orderBy("duration_h", "edge_id")
    return rows.withColumn("first_", F.row_number().over(cell)).where("first_ = 1").drop("first_")


def loop_closure(starts: DataFrame, approaches: DataFrame) -> DataFrame:
    """All start edges, of any variant, from a start that has an approach row."""
    return starts.join(approaches.select("start_id").distinct(), "start_id", "left_semi")


def exit_only(closure: DataFrame, approaches: DataFrame) -> DataFrame:
    """(edge_id, hut_id) of closure edges without an approach row."""
    return closure.join(approaches.select("edge_id"), "edge_id", "left_anti").select("edge_id", "hut_id").distinct()


def selected_pairs(distances: DataFrame, k: int = BEST) -> DataFrame:
    """Access rows (hut_id, start_id, start_type, variant, time_s, ord) of starts that are among the k fastest of some hut and type under FAST_ANY."""
    best = Window.partitionBy("hut_id", "start_type").orderBy("time_s", "ord")
    starts = distances.where(F.col("variant") == FAST_ANY).withColumn("rank_", F.row_number().over(best)).where(F.col("rank_") <= k).select("start_id").distinct()
    return distances.join(starts, "start_id", "left_semi")


def missing_source_types(starts: DataFrame, approaches: DataFrame) -> DataFrame:
    """(hut_id, start_type) that occur among candidates but not among approach rows."""
    return starts.select("hut_id", "start_type").distinct().join(approaches, ["hut_id", "start_type"], "left_anti")


def minutes_to_hut(starts: DataFrame) -> DataFrame:
    """(hut_id, minutes): the fastest start edge, in whole minutes."""
    return starts.groupBy("hut_id").agg(F.round(F.min(hours()) * 60).cast("int").alias("minutes"))


def best_start_legs(legs: DataFrame, variant: int) -> DataFrame:
    """The best leg of each (hut, start): those of the variant before others, then the fastest, then the first."""
    best = Window.partitionBy("hut_id", "start_id").orderBy(F.desc(F.col("variant") == variant), "duration_h", "edge_id")
    return legs.withColumn("best_", F.row_number().over(best)).where("best_ = 1").drop("best_")


def snapped(records: DataFrame) -> DataFrame:
    """Routed records with the gaps to their hubs (gap_u_m, dz_u_m, gap_v_m, dz_v_m) folded into distance and climbs: up to the hub counts as ascent."""
    up = lambda x: F.greatest(x, F.lit(0.0))
    a, b = F.coalesce("dz_u_m", F.lit(0.0)), F.coalesce("dz_v_m", F.lit(0.0))
    return records.withColumns({"distance_m": F.col("distance_m") + F.coalesce("gap_u_m", F.lit(0.0)) + F.coalesce("gap_v_m", F.lit(0.0)), "ascent_m": F.col("ascent_m") + up(a) + up(b), "descent_m": F.col("descent_m") + up(-a) + up(-b)})


def id_runs(records: DataFrame, run: int = 8) -> DataFrame:
    """(edge_id, ids, prefix, suffix): sorted set of segment ids, and the first and last ones outward from either end."""
    return records.select("edge_id", F.array_sort(F.array_distinct("path_ids")).alias("ids"), F.slice("path_ids", 1, run).alias("prefix"), F.slice(F.reverse("path_ids"), 1, run).alias("suffix"))
