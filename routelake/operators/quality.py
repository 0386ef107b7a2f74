"""Data quality checks. Each gives rows of findings; `report` turns them into an envelope with counts, a cap and a truncation mark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.geo import ring_crossed
from routelake.operators import polyline

#: Limits of the checks.
CAP, LEAST_ELE, MOST_ELE, LEAST_MS, MOST_GAP_M, RETRACE_CELL_M, RETRACE_M, ASCENT_CAP_M, SHORT_M, STRAIGHT, FEW_POINTS = 500, -50.0, 4300.0, 0.05, 500.0, 5.0, 200.0, 5000.0, 300.0, 0.97, 4


def with_reasons(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row for each reason whose test is true; an unknown test isn't."""
    found = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())
    return rows.withColumn("reason", F.explode(found))


def report(findings: DataFrame, check: str, phase: str, checked: DataFrame, baseline: int = 0, cap: int = CAP, worst: str | None = None) -> DataFrame:
    """(phase, check, checked, flagged, baseline, truncated, rows): the worst findings first, at most cap of them as JSON; flagged is the true number."""
    order = [F.desc(worst)] if worst else []
    row = F.to_json(F.struct(*sorted(findings.columns)))
    top = findings.select(row.alias("row"), *([F.col(worst)] if worst else [])).orderBy(*order, "row").limit(cap)
    rows = top.agg(F.collect_list(F.struct(*([(-F.col(worst)).alias("k")] if worst else []), "row")).alias("r"))
    n, m = findings.agg(F.count("*").alias("flagged")), checked.agg(F.count("*").alias("checked"))
    # Three tables of one row each.
    out = m.crossJoin(n).crossJoin(rows)
    return out.select(F.lit(phase).alias("phase"), F.lit(check).alias("check"), "checked", "flagged", F.lit(baseline).cast("long").alias("baseline"), (F.col("flagged") > cap).alias("truncated"), F.transform(F.array_sort("r"), lambda x: x["row"]).alias("rows"))


def summary(reports: list[DataFrame]) -> DataFrame:
    """(phase, check, checked, flagged, baseline, above): all checks; above says that more is flagged than on record."""
    return reduce(DataFrame.unionByName, reports).select("phase", "check", "checked", "flagged", "baseline", (F.col("flagged") > F.col("baseline")).alias("above"))


def start_points(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Findings of points (type, id, ord, lon, lat): not finite, outside, or a repeat, which names the first row."""
    key = Window.partitionBy("type", "id")
    marked = points.withColumns({"first_row": F.min("ord").over(key), "nth": F.row_number().over(key.orderBy("ord"))})
    bad = F.isnan("lon") | F.isnan("lat") | F.col("lon").isNull() | F.col("lat").isNull()
    outside = ~bad & ~(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return with_reasons(marked, {"not_finite": bad, "outside_region": outside, "duplicate": F.col("nth") > 1}).select("type", "id", "ord", "reason", F.when(F.col("reason") == "duplicate", F.col("first_row")).alias("first_row"))


def inside(points: DataFrame, rings: DataFrame, cell_deg: float = 0.1) -> DataFrame:
    """Points (pid, lon, lat) inside a polygon given by its ring edges (x1, y1, x2, y2), holes included: edges join by bands of latitude."""
    band = lambda y: F.floor(y / cell_deg)
    edges = rings.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    crossed = points.withColumn("band", band(F.col("lat"))).join(edges, "band").where(ring_crossed(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    odd = crossed.groupBy("pid").agg(F.count("*").alias("n")).where("n % 2 = 1").select("pid")
    return points.join(odd, "pid", "left_semi")


def without_tags(points: DataFrame, tags: DataFrame) -> DataFrame:
    return points.select("type", "id").distinct().join(tags, ["type", "id"], "left_anti")


def elevation_range(nodes: DataFrame, low: float = LEAST_ELE, high: float = MOST_ELE) -> DataFrame:
    return nodes.where(F.col("ele").isNull() | F.isnan("ele") | (F.col("ele") < low) | (F.col("ele") > high))


def unresolved(rows: DataFrame, columns: list[str], sentinel: float = -1.0) -> DataFrame:
    return with_reasons(rows, {c: F.col(c) == sentinel for c in columns})


def slow_edges(edges: DataFrame, least_ms: float = LEAST_MS) -> DataFrame:
    """Edges (length_m, time_s) slower than the least speed; without time the speed is endless."""
    speed = F.when(F.col("time_s") == 0, F.lit(float("inf"))).otherwise(F.try_divide("length_m", "time_s"))
    return edges.withColumn("implied_ms", speed).where(F.col("implied_ms") < least_ms)


def profiles(rows: DataFrame, n: int, low: float = LEAST_ELE, high: float = MOST_ELE) -> DataFrame:
    """Findings of profiles array<double>: wrong length, gaps, out of range."""
    bad = F.exists("profile", lambda x: x.isNull() | F.isnan(x))
    out = F.exists("profile", lambda x: (x < low) | (x > high))
    return with_reasons(rows, {"wrong_length": (F.size("profile") != n) & (F.size("profile") != 0), "not_finite": bad, "out_of_range": out})


def unsnapped(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("hub_type", "hub_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def connectivity(edges: DataFrame, huts: DataFrame) -> DataFrame:
    """(variant, rows, connected, isolated, components, outside_largest) of hut edges (variant, from_id, to_id)."""
    from routelake.operators.graph import components

    named = components(edges.select("variant", F.col("from_id").alias("u"), F.col("to_id").alias("v")), ["variant"])
    sizes = named.groupBy("variant", "component").agg(F.count("*").alias("n"))
    by_variant = sizes.groupBy("variant").agg(F.sum("n").alias("connected"), F.count("*").alias("components"), (F.sum("n") - F.max("n")).alias("outside_largest"))
    counted = edges.groupBy("variant").agg(F.count("*").alias("rows"))
    total = huts.agg(F.countDistinct("hub_id").alias("huts"))
    return counted.join(by_variant, "variant").crossJoin(total).select("variant", "rows", "connected", (F.col("huts") - F.col("connected")).alias("isolated"), "components", "outside_largest")


def beyond_range(edges: DataFrame, limit_m: float) -> DataFrame:
    return edges.where(F.col("distance_m") > limit_m)


def vertex_gaps(vertices: DataFrame, limit_m: float = MOST_GAP_M) -> DataFrame:
    return polyline.worst_gaps(vertices).where(F.col("max_gap_m") > limit_m)


def self_retrace(vertices: DataFrame, cell_m: float = RETRACE_CELL_M, apart_m: float = RETRACE_M) -> DataFrame:
    return polyline.retrace(vertices, cell_m).where((F.col("n_points") >= 3) & (F.col("worst_m") > apart_m))


def scalars(records: DataFrame, lowest_ele: float, cap_m: float = ASCENT_CAP_M) -> DataFrame:
    return with_reasons(records, {"max_ele_below_lowest": F.col("max_ele_m") < lowest_ele, "ascent_over_cap": F.col("ascent_m") > cap_m, "negative_distance": F.col("distance_m") < 0, "negative_ascent": F.col("ascent_m") < 0, "negative_descent": F.col("descent_m") < 0})


def too_straight(vertices: DataFrame, length_m: float = SHORT_M, share: float = STRAIGHT, points: int = FEW_POINTS) -> DataFrame:
    """Long lines of few points that are nearly straight."""
    return polyline.ends(vertices).where((F.col("total_m") >= length_m) & (F.col("n_points") < points) & (F.col("straightness") >= share))


def off_path(anchors: DataFrame, segments: DataFrame, tolerance_m: float) -> DataFrame:
    """Anchors (rec, k, lon, lat) farther than the tolerance from their line's segments (rec, lon_a, lat_a, lon_b, lat_b)."""
    from routelake.functions.geo import metres, nearest_on_segment

    joined = anchors.join(segments, "rec")
    ax, ay = metres(F.col("lon_a"), F.col("lat_a"), F.col("lon"), F.col("lat"))
    bx, by = metres(F.col("lon_b"), F.col("lat_b"), F.col("lon"), F.col("lat"))
    _, d2 = nearest_on_segment(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
    return joined.groupBy("rec", "k").agg(F.sqrt(F.min(d2)).alias("distance_m")).where(F.col("distance_m") > tolerance_m)


def counts_disagree(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Names whose count in a manifest (name, n) differs from what was found, missing ones included."""
    joined = manifest.alias("m").join(found.alias("f"), F.col("m.name") == F.col("f.name"), "full_outer")
    return joined.where(~F.col("m.n").eqNullSafe(F.col("f.n"))).select(F.coalesce("m.name", "f.name").alias("name"), F.col("m.n").alias("stated"), F.col("f.n").alias("found"))


def stale_copies(source: DataFrame, public: DataFrame) -> DataFrame:
    """(name, reason) where the public file (name, hash) is missing or differs."""
    joined = source.alias("s").join(public.alias("p"), F.col("s.name") == F.col("p.name"), "full_outer")
    reason = F.when(F.col("p.name").isNull(), "missing").when(F.col("s.name").isNull(), "orphan").when(F.col("s.hash") != F.col("p.hash"), "differs")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(F.coalesce("s.name", "p.name").alias("name"), "reason")


def every_nth(rows: DataFrame, order: str, about: int = 500) -> DataFrame:
    """About so many rows, evenly spaced in an order. Rows are dealt over ranges of the order, and each range's place follows from the counts before it, so no task sorts them all."""
    from routelake.plans.lineage import cut

    ranged = cut(rows.repartitionByRange(order).withColumn("range_", F.spark_partition_id()))
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    line = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select("range_", F.coalesce(F.sum("n_").over(line), F.lit(0)).alias("before_"))
    step = max(1, ranged.count() // about)
    own = F.row_number().over(Window.partitionBy("range_").orderBy(order)) - 1
    placed = ranged.join(F.broadcast(counts), "range_").withColumn("place_", F.col("before_") + own)
    return placed.where(F.col("place_") % step == 0).select(*rows.columns)
