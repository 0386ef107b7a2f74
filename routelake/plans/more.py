"""More queries: sources, labels, checks, and pieces of the study, the search and the map, one for each operator, beside their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from routelake.fixtures import view
from routelake.functions import geo, text, walking
from routelake.operators import analysis, grading, graph, legs, mapping, polyline, quality, search, spatial, stats, study, trip
from routelake.plans.queries import TABLE_SQL, TOURLIKE_SQL, _huts, _scarce, _facts, _tourlike, din, hav, query, r6, SERIES_SQL
from routelake.sources import io
from routelake.streaming import runs

# Labels and numbers


@query(
    f"SELECT edge_id, CASE WHEN q // 4 > 0 OR q % 4 = 0 THEN CAST(q // 4 AS VARCHAR) ELSE '' END || ['', '¼', '½', '¾'][q % 4 + 1] || ' Std' AS label, CASE WHEN m >= 1000 THEN (m // 1000) || '.' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0') ELSE CAST(m AS VARCHAR) END || ' m' AS height FROM (SELECT edge_id, CAST(FLOOR({din()} * 4 + 0.5) AS BIGINT) AS q, CAST(max_ele_m AS BIGINT) AS m FROM hut_edge) e",
    "hut_edge",
)
def signpost_labels(spark, sf_dir):
    return legs.forward(view(spark, sf_dir, "hut_edge")).select("edge_id", text.signpost_time(F.col("duration_h")).alias("label"), text.metres(F.col("max_ele_m")).alias("height"))


SECONDS_SQL = f"LEAST(distance_m / ({walking.V0} * EXP(-{walking.K} * ABS((ascent_m - descent_m) / distance_m + {walking.S0})) / 3.6), distance_m / {walking.LEAST_MS})"


@query(f"SELECT edge_id, ROUND(CASE WHEN via_ferrata THEN SQRT(distance_m * distance_m + (ascent_m - descent_m) * (ascent_m - descent_m)) / {walking.TECHNICAL_MS} ELSE {SECONDS_SQL} END, 4) AS seconds FROM hut_edge", "hut_edge")
def technical_seconds(spark, sf_dir):
    return view(spark, sf_dir, "hut_edge").select("edge_id", F.round(walking.edge_seconds(F.col("distance_m"), F.col("ascent_m") - F.col("descent_m"), F.col("via_ferrata")), 4).alias("seconds"))


@query(f"SELECT edge_id, ROUND({SECONDS_SQL} * (1 + (2.5 - 1) * (edge_id % 5) / 4.0), 4) AS weight FROM hut_edge", "hut_edge")
def road_weights(spark, sf_dir):
    e = view(spark, sf_dir, "hut_edge")
    return e.select("edge_id", F.round(walking.road_weight(walking.edge_seconds(F.col("distance_m"), F.col("ascent_m") - F.col("descent_m")), 2.5, (F.col("edge_id") % 5) / 4), 4).alias("weight"))


@query(f"SELECT hub_type, hub_id, ROUND((lon - 11.0) * {geo.DEGREE_M!r} * COS(RADIANS(47.0)), 4) AS x, ROUND((lat - 47.0) * {geo.DEGREE_M!r}, 4) AS y FROM hub", "hub")
def local_metres(spark, sf_dir):
    x, y = geo.metres(F.col("lon"), F.col("lat"), F.lit(11.0), F.lit(47.0))
    return view(spark, sf_dir, "hub").select("hub_type", "hub_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("SELECT hub_type, hub_id, CAST(q AS INT) AS q, ROUND(base + q * 1e-4, 6) AS lon FROM (SELECT hub_type, hub_id, FLOOR(lon) AS base, ROUND_EVEN((lon - FLOOR(lon)) / 1e-4, 0) AS q FROM hub) h", "hub")
def anchor_offsets(spark, sf_dir):
    h = view(spark, sf_dir, "hub").withColumn("base", F.floor("lon").cast("double"))
    h = h.withColumn("q", geo.quantised_offset(F.col("lon"), F.col("base")))
    return h.select("hub_type", "hub_id", F.col("q").cast("int").alias("q"), F.round(geo.decoded_offset(F.col("q"), F.col("base")), 6).alias("lon"))


@query("SELECT hub_type, hub_id, hub_id AS number, hub_id // 2 AS osm, CASE WHEN hub_id % 2 = 0 THEN 'way' ELSE 'relation' END AS kind FROM hub", "hub")
def feature_numbers(spark, sf_dir):
    h = view(spark, sf_dir, "hub")
    osm, kind = text.area_id(F.col("hub_id"))
    return h.select("hub_type", "hub_id", text.number_of_feature(F.concat(F.lit("n"), F.col("hub_id").cast("string"))).alias("number"), osm.alias("osm"), kind.alias("kind"))


@query("SELECT tour, UPPER(array_to_string(list_transform(huts, lambda h: '{a-' || h || 'f}'), '/')) AS tokens FROM tours", more=TOURLIKE_SQL)
def guid_tokens(spark, sf_dir):
    listed = F.array_join(F.transform("huts", lambda h: F.concat(F.lit("{a-"), h.cast("string"), F.lit("f}"))), ", ")
    return _tourlike(spark, sf_dir).select("tour", F.array_join(text.guids(listed), "/").alias("tokens"))


@query("SELECT tour, (tour % 100) || '|' || array_to_string(huts, '>') || '|' || (tour % 90) AS key FROM tours", more=TOURLIKE_SQL)
def tour_keys(spark, sf_dir):
    return _tourlike(spark, sf_dir).select("tour", text.tour_key(F.col("tour") % 100, F.col("huts"), F.col("tour") % 90).alias("key"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%d.%m.%Y') AS day, strftime(CAST(o_orderdate AS DATE), '%d.%m.') AS short FROM orders")
def date_labels(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", text.german_date(F.to_date("o_orderdate")).alias("day"), text.day_month(F.to_date("o_orderdate")).alias("short"))


@query("SELECT edge_id, CASE WHEN edge_id % 5 = 2 THEN 'hovered' WHEN edge_id % 5 = 3 THEN 'focused' ELSE 'rest' END AS tier FROM hut_edge", "hut_edge")
def emphasis_tiers(spark, sf_dir):
    return view(spark, sf_dir, "hut_edge").select("edge_id", mapping.emphasis(F.col("edge_id") % 5, F.lit(2), F.lit(3)).alias("tier"))


@query("""SELECT s_suppkey, sha256('{"v":' || s_suppkey || '}') AS hash FROM supplier""")
def content_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", text.content_hash(F.col("s_suppkey")).alias("hash"))


@query("SELECT hub_type, hub_id, ROUND(lon + 0.005, 6) AS lon, ROUND(lat + 0.01, 6) AS lat FROM hub", "hub")
def area_centroids(spark, sf_dir):
    """Centres of parking areas, here boxes beside each hub."""
    at = lambda x, y: F.struct((F.col("lon") - 11 + x).alias("lon"), (F.col("lat") - 47 + y).alias("lat"))
    c = mapping.centroid(F.array(at(0, 0), at(0.01, 0), at(0.01, 0.02), at(0, 0.02), at(0, 0)))
    return view(spark, sf_dir, "hub").select("hub_type", "hub_id", F.round(c["lon"] + 11, 6).alias("lon"), F.round(c["lat"] + 47, 6).alias("lat"))


@query("SELECT edge_id, CASE WHEN a AND NOT b THEN 'ungraded' WHEN b AND NOT a THEN 'difficulty' WHEN a AND b THEN 'combined' ELSE 'disconnected' END AS blocker FROM (SELECT edge_id, sac_rank < 0 AS a, via_ferrata OR sac_rank > 3 AS b FROM hut_edge) e", "hut_edge")
def blocker_kinds(spark, sf_dir):
    return view(spark, sf_dir, "hut_edge").select("edge_id", analysis.blocker(F.col("sac_rank") < 0, F.col("via_ferrata") | (F.col("sac_rank") > 3)).alias("blocker"))


# Checks


@query(
    "SELECT type, id, ord, reason, first_row FROM (SELECT *, UNNEST([CASE WHEN lon IS NULL THEN 'not_finite' END, CASE WHEN lon IS NOT NULL AND NOT (lon BETWEEN 10 AND 16 AND lat BETWEEN 46 AND 48) THEN 'outside_region' END, CASE WHEN nth > 1 THEN 'duplicate' END]) AS reason FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY type, id ORDER BY ord) AS nth, MIN(ord) OVER (PARTITION BY type, id) AS f FROM p) w) r, LATERAL (SELECT CASE WHEN reason = 'duplicate' THEN f END AS first_row) l WHERE reason IS NOT NULL",
    "hub",
    more="p AS (SELECT hub_type AS type, hub_id // 2 AS id, hub_id AS ord, CASE WHEN hub_id % 17 = 0 THEN NULL ELSE lon END AS lon, lat FROM hub WHERE hub_type > 0)",
)
def start_point_findings(spark, sf_dir):
    p = view(spark, sf_dir, "hub").where("hub_type > 0").select(F.col("hub_type").alias("type"), F.floor(F.col("hub_id") / 2).alias("id"), F.col("hub_id").alias("ord"), F.when(F.col("hub_id") % 17 != 0, F.col("lon")).alias("lon"), "lat")
    return quality.start_points(p, (10.0, 46.0, 16.0, 48.0))


RING = ((10.0, 46.5), (14.0, 46.6), (15.0, 47.9), (11.0, 48.2))
HOLE = ((12.0, 47.0), (13.0, 47.0), (12.6, 47.5))
EDGES = [(*a, *b) for ring in (RING, HOLE) for a, b in zip(ring, (*ring[1:], ring[0]), strict=True)]


@query(
    f"SELECT h.hub_type, h.hub_id FROM hub h JOIN (VALUES {', '.join(f'({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)' for a, b, c, d in EDGES)}) r(x1, y1, x2, y2) ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY h.hub_type, h.hub_id HAVING COUNT(*) % 2 = 1",
    "hub",
)
def points_in_region(spark, sf_dir):
    rings = spark.createDataFrame(EDGES, "x1 double, y1 double, x2 double, y2 double")
    points = view(spark, sf_dir, "hub").withColumn("pid", F.struct("hub_type", "hub_id"))
    return quality.inside(points, rings).select("hub_type", "hub_id")


@query("SELECT DISTINCT hub_type AS type, hub_id AS id FROM hub WHERE hub_type > 0 AND hub_id % 4 <> 1", "hub")
def untagged_points(spark, sf_dir):
    h = view(spark, sf_dir, "hub").where("hub_type > 0").select(F.col("hub_type").alias("type"), F.col("hub_id").alias("id"))
    return quality.without_tags(h, h.where("id % 4 = 1"))


@query("SELECT edge_id, reason FROM (SELECT edge_id, UNNEST([CASE WHEN sac_rank = -1 THEN 'sac_rank' END, CASE WHEN max_ele_m = -1 THEN 'max_ele_m' END]) AS reason FROM hut_edge) e WHERE reason IS NOT NULL", "hut_edge")
def unresolved_values(spark, sf_dir):
    return quality.unresolved(view(spark, sf_dir, "hut_edge"), ["sac_rank", "max_ele_m"]).select("edge_id", "reason")


@query("SELECT rec, reason FROM (SELECT rec, UNNEST([CASE WHEN COUNT(*) <> 4 THEN 'wrong_length' END, CASE WHEN COUNT(*) > COUNT(ele) THEN 'not_finite' END, CASE WHEN MAX(ele) > 1900 OR MIN(ele) < 1050 THEN 'out_of_range' END]) AS reason FROM vertex GROUP BY rec) v WHERE reason IS NOT NULL", "vertex")
def profile_findings(spark, sf_dir):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ele"))), lambda x: x["ele"])
    return quality.profiles(view(spark, sf_dir, "vertex").groupBy("rec").agg(listed.alias("profile")), 4, 1050.0, 1900.0).select("rec", "reason")


@query("SELECT rec, pos FROM vertex WHERE ele IS NULL OR ele < 1100 OR ele > 1800", "vertex")
def elevation_findings(spark, sf_dir):
    return quality.elevation_range(view(spark, sf_dir, "vertex"), 1100.0, 1800.0).select("rec", "pos")


@query("SELECT start_type AS hub_type, start_id AS hub_id, array_to_string(list_sort(LIST(DISTINCT reason)), ',') AS reasons FROM (SELECT start_type, start_id, CASE WHEN distance_m > 20000 THEN 'gap_too_far' WHEN ascent_m > 1000 THEN 'vertical_offset' END AS reason FROM start_record) r WHERE reason IS NOT NULL GROUP BY 1, 2", "start_record")
def snap_rejections(spark, sf_dir):
    r = view(spark, sf_dir, "start_record").withColumn("reason", F.when(F.col("distance_m") > 20000, "gap_too_far").when(F.col("ascent_m") > 1000, "vertical_offset")).where("reason IS NOT NULL")
    return quality.unsnapped(r.select(F.col("start_type").alias("hub_type"), F.col("start_id").alias("hub_id"), "reason")).select("hub_type", "hub_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT COALESCE(m.name, f.name) AS name, m.n AS stated, f.n AS found FROM (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS n FROM nation) m FULL JOIN (SELECT n_name AS name, COUNT(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name) f ON f.name = m.name WHERE m.n IS DISTINCT FROM f.n")
def manifest_counts(spark, sf_dir):
    view(spark, sf_dir, "hub")
    stated = spark.table("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("n"))
    found = spark.table("supplier").join(spark.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    return quality.counts_disagree(stated, found)


@query("SELECT COALESCE(s.name, p.name) AS name, CASE WHEN p.name IS NULL THEN 'missing' WHEN s.name IS NULL THEN 'orphan' ELSE 'differs' END AS reason FROM (SELECT c_name AS name, sha256(c_mktsegment) AS hash FROM customer WHERE c_custkey % 7 <> 0) s FULL JOIN (SELECT c_name AS name, sha256(CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE c_mktsegment END) AS hash FROM customer WHERE c_custkey % 3 <> 0) p ON s.name = p.name WHERE p.name IS NULL OR s.name IS NULL OR s.hash <> p.hash")
def stale_files(spark, sf_dir):
    """Some source files and some public copies are missing, others are old."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    body = F.col("c_mktsegment")
    source = c.where("c_custkey % 7 <> 0").select(F.col("c_name").alias("name"), F.sha2(body, 256).alias("hash"))
    public = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.sha2(F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(body), 256).alias("hash"))
    return quality.stale_copies(source, public)


@query("SELECT 'routing' AS phase, 'long_edges' AS \"check\", (SELECT COUNT(*) FROM hut_edge) AS checked, COUNT(*) AS flagged, CAST(2 AS BIGINT) AS baseline, COUNT(*) > 20 AS truncated, CAST(LEAST(COUNT(*), 20) AS INT) AS shown, MAX(distance_m) AS worst FROM hut_edge WHERE distance_m > 9000", "hut_edge")
def worst_findings(spark, sf_dir):
    e = view(spark, sf_dir, "hut_edge").select("edge_id", "distance_m")
    out = quality.report(quality.beyond_range(e, 9000.0), "long_edges", "routing", e, baseline=2, cap=20, worst="distance_m")
    return out.select("phase", "check", "checked", "flagged", "baseline", "truncated", F.size("rows").alias("shown"), F.get_json_object(F.col("rows")[0], "$.distance_m").cast("double").alias("worst"))


@query("SELECT rec, pos FROM (SELECT rec, pos, ROW_NUMBER() OVER (ORDER BY rec, pos) - 1 AS k, COUNT(*) OVER () AS n FROM vertex) v WHERE k % GREATEST(1, n // 500) = 0", "vertex")
def sample_every_nth(spark, sf_dir):
    v = view(spark, sf_dir, "vertex").withColumn("at", F.struct("rec", "pos"))
    return quality.every_nth(v, "at").select("rec", "pos")


@query(
    f"SELECT rec, pos AS k, ROUND(MIN(SQRT(POW(ax + t * (bx - ax), 2) + POW(ay + t * (by_ - ay), 2))), 3) AS distance_m FROM (SELECT *, CASE WHEN POW(bx - ax, 2) + POW(by_ - ay, 2) > 0 THEN LEAST(GREATEST((-ax * (bx - ax) - ay * (by_ - ay)) / (POW(bx - ax, 2) + POW(by_ - ay, 2)), 0), 1) ELSE 0 END AS t FROM (SELECT a.rec, a.pos, (s.lon - a.lon) * {geo.DEGREE_M!r} * COS(RADIANS(a.lat)) AS ax, (s.lat - a.lat) * {geo.DEGREE_M!r} AS ay, (s.lon2 - a.lon) * {geo.DEGREE_M!r} * COS(RADIANS(a.lat)) AS bx, (s.lat2 - a.lat) * {geo.DEGREE_M!r} AS by_ FROM anchor a JOIN (SELECT rec, lon, lat, LEAD(lon) OVER w AS lon2, LEAD(lat) OVER w AS lat2 FROM vertex WINDOW w AS (PARTITION BY rec ORDER BY pos)) s ON s.rec = a.rec AND s.lon2 IS NOT NULL) j) t GROUP BY rec, pos HAVING MIN(SQRT(POW(ax + t * (bx - ax), 2) + POW(ay + t * (by_ - ay), 2))) > 25",
    "vertex",
    more="anchor AS (SELECT rec, pos, lon + 0.0003 AS lon, lat - 0.0002 AS lat FROM vertex)",
)
def anchors_off_path(spark, sf_dir):
    v = view(spark, sf_dir, "vertex")
    line = Window.partitionBy("rec").orderBy("pos")
    segments = v.select("rec", F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), F.lead("lon").over(line).alias("lon_b"), F.lead("lat").over(line).alias("lat_b")).where("lon_b IS NOT NULL")
    return quality.off_path(v.select("rec", F.col("pos").alias("k"), (F.col("lon") + 0.0003).alias("lon"), (F.col("lat") - 0.0002).alias("lat")), segments, 25.0).select("rec", "k", F.round("distance_m", 3).alias("distance_m"))


# Study


@query("SELECT COUNT(*) AS days, COUNT(*) FILTER (WHERE ABS(free_place - b) > 1) AS differing FROM (SELECT free_place, free_place + ohrs_id % 4 AS b FROM hut_day WHERE ohrs_id % 3 <> 0) d", "hut_day")
def calendar_consistency(spark, sf_dir):
    d = view(spark, sf_dir, "hut_day")
    return study.consistency(d, d.where("ohrs_id % 3 <> 0").withColumn("free_place", F.col("free_place") + F.col("ohrs_id") % 4))


@query(
    f"SELECT a, CAST(hut AS BIGINT) AS placebo FROM (SELECT x.ohrs_id AS a, y.ohrs_id AS hut, ROW_NUMBER() OVER (PARTITION BY x.ohrs_id ORDER BY {hav('x.lon', 'x.lat', 'y.lon', 'y.lat')}, y.ohrs_id) AS k FROM huts x JOIN huts y ON x.tour > 0 AND y.tour = 0 AND ABS(LN(y.capacity) - LN(x.capacity)) <= {study.PLACEBO_LOG_TOL!r}) p WHERE k = 1",
    "hub",
    more=TABLE_SQL,
)
def placebo_huts(spark, sf_dir):
    t = _huts(spark, sf_dir)
    return study.placebo(t.where("tour > 0").withColumnRenamed("ohrs_id", "a"), t.where("tour = 0"))


@query(
    "SELECT f.ohrs_id, f.on_tour, f.elevation, CAST(c.capacity AS INT) AS capacity, f.minutes AS approach_time_min, CASE WHEN NOT f.serviced THEN 'self_service' WHEN c.capacity IS NULL OR c.capacity <= 0 THEN 'no_capacity' WHEN d.ohrs_id IS NULL THEN 'no_calendar' END AS error FROM (SELECT ohrs_id, tour > 0 AS on_tour, elevation, ohrs_id % 4 <> 0 AS serviced, CASE WHEN ohrs_id % 2 = 0 THEN CAST(ohrs_id % 50 AS INT) END AS minutes FROM huts) f LEFT JOIN (SELECT ohrs_id, capacity FROM huts WHERE ohrs_id % 5 <> 0) c ON c.ohrs_id = f.ohrs_id LEFT JOIN (SELECT DISTINCT ohrs_id FROM hut_day) d ON d.ohrs_id = f.ohrs_id",
    "hub",
    "hut_day",
    more=TABLE_SQL,
)
def hut_master(spark, sf_dir):
    t = _huts(spark, sf_dir)
    guid = F.concat(F.lit("{h"), F.col("ohrs_id").cast("string"), F.lit("}"))
    features = t.select("ohrs_id", guid.alias("guid"), F.lit("Hütte").alias("name"), (F.col("ohrs_id") % 4 != 0).alias("serviced"), "elevation", F.lit(8).alias("club"), "lon", "lat")
    minutes = t.where("ohrs_id % 2 = 0").select(F.upper(guid).alias("guid"), (F.col("ohrs_id") % 50).cast("int").alias("minutes"))
    out = study.linked(features, t.where("ohrs_id % 5 <> 0").select("ohrs_id", "capacity"), t.where("tour > 0").select(F.upper(guid).alias("guid")), minutes, view(spark, sf_dir, "hut_day"))
    return out.select("ohrs_id", "on_tour", "elevation", "capacity", "approach_time_min", "error")


@query("SELECT DISTINCT 'H' || l_suppkey AS guid FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)")
def unmatched_guids(spark, sf_dir):
    view(spark, sf_dir, "hub")
    tours = spark.table("lineitem").select(F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("guid"))
    return study.unmatched_guids(tours, spark.table("supplier").where("s_nationkey % 2 = 0").select(F.concat(F.lit("H"), F.col("s_suppkey").cast("string")).alias("guid")))


@query("SELECT ohrs_id FROM huts WHERE capacity >= 40 AND NOT sold_out_share > 0.7", "hub", more=TABLE_SQL)
def eligible_huts(spark, sf_dir):
    t = _huts(spark, sf_dir).select("ohrs_id", (F.col("capacity") >= 40).alias("eligible"), (F.col("sold_out_share") > 0.7).alias("no_activity"), (F.col("ohrs_id") % 6 == 0).alias("capacity_mismatch"))
    return study.selected(t, ("capacity_mismatch",)).select("ohrs_id")


@query("SELECT o.k, s.ohrs_id, CAST(s.d AS VARCHAR) AS d, CAST(p.v AS DOUBLE) AS treat FROM series s CROSS JOIN (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) o(k) LEFT JOIN series p ON p.ohrs_id = s.ohrs_id AND p.d = s.d - o.k", "hut_day", more=SERIES_SQL)
def treatment_offsets(spark, sf_dir):
    return study.offset_treatments(study.full_series(_scarce(_facts(spark, sf_dir)))).select("k", "ohrs_id", F.col("d").cast("string").alias("d"), "treat")


EFFECTS_SQL = "effects AS (SELECT tour, h AS a, CAST((h * 37 + tour * 11) % 101 AS DOUBLE) / 100 - 0.5 AS effect FROM (SELECT DISTINCT tour, UNNEST(huts) AS h FROM tours) t), chosen AS (SELECT tour, list_min(huts) AS a FROM tours)"


@query("SELECT COUNT(*) AS tours, ROUND(AVG(CASE WHEN b.a = c.a THEN 1.0 ELSE 0.0 END), 9) AS observed, ROUND(AVG(1.0 / b.n), 9) AS chance FROM (SELECT tour, a, ROW_NUMBER() OVER (PARTITION BY tour ORDER BY effect, a) AS k, COUNT(*) OVER (PARTITION BY tour) AS n FROM effects) b JOIN chosen c ON c.tour = b.tour WHERE b.k = 1 AND b.n >= 2", more=TOURLIKE_SQL + ", " + EFFECTS_SQL)
def bottleneck_rank(spark, sf_dir):
    t = _tourlike(spark, sf_dir)
    effects = t.select("tour", F.explode(F.array_distinct("huts")).alias("a")).withColumn("effect", ((F.col("a") * 37 + F.col("tour") * 11) % 101).cast("double") / 100 - 0.5)
    got = study.rank_share(effects, t.select("tour", F.array_min("huts").alias("a")))
    return got.select("tours", F.round("observed", 9).alias("observed"), F.round("chance", 9).alias("chance"))


@query("SELECT n_name AS known_name, CASE WHEN n = 1 THEN name END AS name FROM (SELECT k.n_name, COUNT(c.name) AS n, MIN(c.name) AS name FROM nation k LEFT JOIN (SELECT n_name || '-Tour ' || r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name || ' Rundweg' FROM nation WHERE n_nationkey % 6 = 0) c ON starts_with(regexp_replace(lower(c.name), '[^a-zäöüß0-9]', '', 'g'), regexp_replace(lower(k.n_name), '[^a-zäöüß0-9]', '', 'g')) GROUP BY k.n_name) m")
def name_matches(spark, sf_dir):
    view(spark, sf_dir, "hub")
    n = spark.table("nation")
    official = n.where("n_nationkey % 2 = 0").join(spark.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat("n_name", F.lit("-Tour "), "r_name").alias("name"))
    official = official.unionByName(n.where("n_nationkey % 6 = 0").select(F.concat("n_name", F.lit(" Rundweg")).alias("name")))
    return study.matched_names(official, n.select(F.col("n_name").alias("known_name")))


@query(
    "SELECT o_custkey AS tour, array_to_string(LIST(hut ORDER BY ord), '>') AS seq FROM (SELECT o_custkey, ord, hut, LAG(hut) OVER (PARTITION BY o_custkey ORDER BY ord) AS before FROM (SELECT o_custkey, l_orderkey * 100 + pos AS ord, l_suppkey % 3 AS hut FROM (SELECT l_orderkey, l_suppkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_extendedprice) AS pos FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey) x) y WHERE before IS NULL OR before <> hut GROUP BY o_custkey",
)
def collapsed_sequences(spark, sf_dir):
    view(spark, sf_dir, "hub")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_extendedprice"))
    rows = spark.table("lineitem").withColumn("pos", pos).join(spark.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("tour"), (F.col("l_orderkey") * 100 + F.col("pos")).alias("ord"), (F.col("l_suppkey") % 3).alias("hut"))
    return study.collapsed(rows).select("tour", F.array_join(F.col("seq").cast("array<string>"), ">").alias("seq"))


@query(f"SELECT tour, ROUND({stats.detection_factor()!r} * STDDEV_SAMP(capacity) * SQRT(1.0 / COUNT(*) + 1.0 / (SELECT COUNT(*) FROM huts WHERE tour = 0)), 6) AS least FROM huts GROUP BY tour", "hub", more=TABLE_SQL)
def detectable_difference(spark, sf_dir):
    t = _huts(spark, sf_dir)
    zero = t.where("tour = 0").agg(F.count("*").alias("n0"))
    return t.groupBy("tour").agg(F.count("*").alias("n"), F.stddev_samp("capacity").alias("sd")).join(zero).select("tour", F.round(stats.least_detectable(F.col("n"), F.col("n0"), F.col("sd")), 6).alias("least"))


@query("SELECT a.tour AS a, b.tour AS b, SIGN(a.m) = SIGN(b.m) AND a.m - a.s <= b.m + b.s AND b.m - b.s <= a.m + a.s AS replicated FROM e a JOIN e b ON a.tour < b.tour", "hub", more=TABLE_SQL + ", e AS (SELECT tour, AVG(sold_out_share) - 0.4 AS m, STDDEV_SAMP(sold_out_share) / SQRT(COUNT(*)) AS s FROM huts GROUP BY tour)")
def replicated_effects(spark, sf_dir):
    e = _huts(spark, sf_dir).groupBy("tour").agg((F.avg("sold_out_share") - 0.4).alias("m"), (F.stddev_samp("sold_out_share") / F.sqrt(F.count("*"))).alias("s"))
    e = e.select("tour", F.struct(F.col("m").alias("coef"), (F.col("m") - F.col("s")).alias("lo"), (F.col("m") + F.col("s")).alias("hi")).alias("fit"))
    pairs = e.alias("a").join(e.alias("b"), F.col("a.tour") < F.col("b.tour"))  # three rows
    return pairs.select(F.col("a.tour").alias("a"), F.col("b.tour").alias("b"), stats.replicated(F.col("a.fit"), F.col("b.fit")).alias("replicated"))


@query("SELECT sac_rank, distance_m AS p90_m FROM (SELECT sac_rank, distance_m, ROW_NUMBER() OVER (PARTITION BY sac_rank ORDER BY distance_m) AS k, COUNT(*) OVER (PARTITION BY sac_rank) AS n FROM hut_edge) e WHERE k = LEAST(n, FLOOR(n * 0.9) + 1)", "hut_edge")
def nearest_rank_lengths(spark, sf_dir):
    return stats.nearest_rank(view(spark, sf_dir, "hut_edge"), ["sac_rank"], "distance_m", 0.9).withColumnRenamed("distance_m", "p90_m")


# Legs, tours, trips


@query(f"SELECT hut_id, start_id, edge_id, variant, ROUND(h, 6) AS duration_h FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hut_id, start_id ORDER BY variant <> 1, h, edge_id) AS k FROM (SELECT *, {din()} AS h FROM start_record) r) b WHERE k = 1", "start_record")
def best_start_legs(spark, sf_dir):
    return legs.best_start_legs(legs.forward(view(spark, sf_dir, "start_record")), 1).select("hut_id", "start_id", "edge_id", "variant", r6("duration_h"))


SNAP_SQL = "snap AS (SELECT edge_id, distance_m, ascent_m, descent_m, CASE WHEN edge_id % 3 > 0 THEN edge_id % 90 + 0.5 END AS gu, CASE WHEN edge_id % 4 > 0 THEN edge_id % 40 - 20.0 END AS zu, edge_id % 70 * 1.0 AS gv, edge_id % 30 - 15.0 AS zv FROM hut_edge)"


@query("SELECT edge_id, ROUND(distance_m + COALESCE(gu, 0) + gv, 6) AS distance_m, ROUND(ascent_m + GREATEST(COALESCE(zu, 0), 0) + GREATEST(zv, 0), 6) AS ascent_m, ROUND(descent_m + GREATEST(-COALESCE(zu, 0), 0) + GREATEST(-zv, 0), 6) AS descent_m FROM snap", "hut_edge", more=SNAP_SQL)
def snapped_records(spark, sf_dir):
    e, k = view(spark, sf_dir, "hut_edge"), F.col("edge_id")
    return legs.snapped(e.withColumns({"gap_u_m": F.when(k % 3 > 0, k % 90 + 0.5), "dz_u_m": F.when(k % 4 > 0, k % 40 - 20.0), "gap_v_m": k % 70 * 1.0, "dz_v_m": k % 30 - 15.0})).select("edge_id", r6("distance_m"), r6("ascent_m"), r6("descent_m"))


@query("SELECT edge_id, CAST(len(list_distinct(p)) AS INT) AS ids, array_to_string(list_slice(p, 1, 8), ' ') AS prefix, array_to_string(list_slice(list_reverse(p), 1, 8), ' ') AS suffix FROM (SELECT edge_id, list_transform(range(0, 3 + edge_id % 12), lambda i: (from_id * 13 + i * i * 7) % 50) AS p FROM hut_edge) e", "hut_edge")
def id_run_sets(spark, sf_dir):
    e = view(spark, sf_dir, "hut_edge").withColumn("path_ids", F.transform(F.sequence(F.lit(0).cast("long"), 2 + F.col("edge_id") % 12), lambda i: (F.col("from_id") * 13 + i * i * 7) % 50))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return legs.id_runs(e).select("edge_id", F.size("ids").alias("ids"), joined("prefix"), joined("suffix"))


@query("SELECT tour % 50 AS start_id, COUNT(*) AS n, MIN(tour) AS first_place FROM tours GROUP BY 1", more=TOURLIKE_SQL)
def tours_by_start(spark, sf_dir):
    t = _tourlike(spark, sf_dir).select((F.col("tour") % 50).alias("start_id"), F.col("tour").alias("place"))
    return search.by_start(t)


@query("SELECT MIN(start_id) AS start_id FROM (SELECT start_id, n, MAX(n) OVER () AS most FROM (SELECT tour % 50 AS start_id, COUNT(*) AS n FROM tours GROUP BY 1) s) m WHERE n = most", more=TOURLIKE_SQL)
def best_start_of_tours(spark, sf_dir):
    t = _tourlike(spark, sf_dir).select((F.col("tour") % 50).alias("start_id"), F.col("tour").alias("place"))
    return search.best_start(t)


@query(
    "SELECT kind, key, array_to_string(list_sort(LIST(DISTINCT tour)), ',') AS tours FROM (SELECT 'hut' AS kind, tour, CAST(UNNEST(huts) AS VARCHAR) AS key FROM tours UNION ALL SELECT 'end', tour, CAST(tour % 30 AS VARCHAR) FROM tours UNION ALL SELECT 'end', tour, CAST(tour % 20 AS VARCHAR) FROM tours UNION ALL SELECT 'leg', tour, LEAST(p[i], p[i + 1]) || '-' || GREATEST(p[i], p[i + 1]) FROM (SELECT tour, p, UNNEST(range(1, len(p))) AS i FROM (SELECT tour, list_concat(['s' || (tour % 30)], list_transform(huts, lambda h: 'h' || h), ['s' || (tour % 20)]) AS p FROM tours) a) b) c GROUP BY kind, key",
    more=TOURLIKE_SQL,
)
def tour_index(spark, sf_dir):
    t = _tourlike(spark, sf_dir).select(F.col("tour").alias("tour_id"), "huts", (F.col("tour") % 30).alias("start_id"), (F.col("tour") % 20).alias("exit_start_id"))
    return search.indexed(t).select("kind", "key", F.array_join(F.col("tours").cast("array<string>"), ",").alias("tours"))


LINES_SQL = "lines AS (SELECT rec, MIN(lon) AS w, MAX(lon) AS e, MIN(lat) AS s, MAX(lat) AS n FROM vertex GROUP BY rec)"


@query("SELECT rec FROM lines WHERE e >= 11.002 AND w <= 11.004 AND n >= 47.0002 AND s <= 47.004", "vertex", more=LINES_SQL)
def tours_touching(spark, sf_dir):
    t = view(spark, sf_dir, "vertex").groupBy("rec").agg(F.collect_list(F.struct("lon", "lat")).alias("points"))
    return search.touching(t, (11.002, 47.0002, 11.004, 47.004)).select("rec")


@query("SELECT l_orderkey AS trip_id, ROUND(SUM(l_quantity / 8.0), 6) AS duration_h, COUNT(*) AS legs FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1")
def leg_totals(spark, sf_dir):
    view(spark, sf_dir, "hub")
    rows = spark.table("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")).alias("edge_id"), (F.col("l_quantity") / 8).alias("duration_h"))
    return trip.totals(rows).select("trip_id", r6("duration_h"), "legs")


# Graph, lines, rasters


SPLIT_SQL = "graph AS (SELECT edge_id, from_id AS u, to_id AS v, distance_m AS length_m, distance_m / 1.2 AS time_s, ascent_m, descent_m FROM hut_edge), cuts AS (SELECT edge_id, -edge_id AS hub_node, (edge_id % 9 + 0.5) / 10 AS share FROM graph WHERE edge_id % 3 = 0)"


@query("SELECT edge_id * 3 AS edge_id, u, v, ROUND(length_m, 6) AS length_m, ROUND(time_s, 6) AS time_s, ROUND(ascent_m, 6) AS ascent_m FROM graph WHERE edge_id % 3 <> 0 UNION ALL SELECT g.edge_id * 3 + 1, u, hub_node, ROUND(length_m * share, 6), ROUND(time_s * share, 6), ROUND(ascent_m * share, 6) FROM graph g JOIN cuts c ON c.edge_id = g.edge_id UNION ALL SELECT g.edge_id * 3 + 2, hub_node, v, ROUND(length_m * (1 - share), 6), ROUND(time_s * (1 - share), 6), ROUND(ascent_m * (1 - share), 6) FROM graph g JOIN cuts c ON c.edge_id = g.edge_id", "hut_edge", more=SPLIT_SQL)
def split_halves(spark, sf_dir):
    e = view(spark, sf_dir, "hut_edge").select("edge_id", F.col("from_id").alias("u"), F.col("to_id").alias("v"), F.col("distance_m").alias("length_m"), (F.col("distance_m") / 1.2).alias("time_s"), "ascent_m", "descent_m")
    cuts = e.where("edge_id % 3 = 0").select("edge_id", (-F.col("edge_id")).alias("hub_node"), ((F.col("edge_id") % 9 + 0.5) / 10).alias("share"))
    return graph.split_edges(e, cuts, "share").select("edge_id", "u", "v", r6("length_m"), r6("time_s"), r6("ascent_m"))


@query("SELECT DISTINCT n AS node_id FROM (SELECT from_id AS n FROM hut_edge WHERE from_id % 8 = 1 OR to_id % 8 = 1 UNION ALL SELECT to_id FROM hut_edge WHERE from_id % 8 = 1 OR to_id % 8 = 1 UNION ALL SELECT hub_id FROM hub WHERE hub_type = 0 AND hub_id % 8 = 1) x", "hub", "hut_edge")
def cell_closure(spark, sf_dir):
    """Nodes of one of eight cells and one step beyond."""
    nodes = view(spark, sf_dir, "hub").where("hub_type = 0").select(F.col("hub_id").alias("node_id"), (F.col("hub_id") % 8).alias("cell_id"))
    edges = view(spark, sf_dir, "hut_edge").select("edge_id", F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    return graph.subgraph(nodes, edges, spark.range(1, 2).select(F.col("id").alias("cell_id")))[0].select("node_id")


@query("SELECT rec AS edge_id, CAST(pos AS INT) AS pos, p AS a, q AS b FROM (SELECT rec, pos, lon * 1000 + lat AS p, LEAD(lon * 1000 + lat) OVER (PARTITION BY rec ORDER BY pos) AS q FROM vertex) v WHERE q IS NOT NULL", "vertex")
def raw_from_chains(spark, sf_dir):
    p = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("lon") * 1000 + F.col("lat")).alias("p")))), lambda x: x["p"])
    chains = view(spark, sf_dir, "vertex").groupBy(F.col("rec").alias("edge_id")).agg(p.alias("p")).where("size(p) > 1")
    return graph.raw_segments(chains.select("edge_id", F.element_at("p", 1).alias("u_point"), F.element_at("p", -1).alias("v_point"), F.slice("p", F.lit(2), F.size("p") - 2).alias("interior")))


@query("SELECT edge_id, edge_id * 3 + k AS half_id, ROUND(distance_m * CASE k WHEN 1 THEN 0.3 ELSE 0.7 END, 6) AS length_m, ROUND(ascent_m * CASE k WHEN 1 THEN 0.3 ELSE 0.7 END, 6) AS ascent_m, CAST(2 AS INT) AS points FROM hut_edge CROSS JOIN (VALUES (1), (2)) h(k)", "hut_edge")
def edges_split_at(spark, sf_dir):
    point = lambda c: F.struct((F.col(c) * 1.0).alias("lon"), (F.col(c) * 2.0).alias("lat"))
    e = view(spark, sf_dir, "hut_edge").select("edge_id", F.col("distance_m").alias("length_m"), "ascent_m", "descent_m", F.array(point("from_id"), point("to_id")).alias("points"), F.lit(0).alias("seg"), F.lit(0.3).cast("double").alias("t"), F.lit(0.3).cast("double").alias("f"))
    return polyline.split_at(e).select("edge_id", "half_id", r6("length_m"), r6("ascent_m"), F.size("points").alias("points"))


@query("SELECT hub_id AS id, ROUND(100 + 2 * (lon - 9.0) / 0.25 + 3 * (lat - 46.0) / 0.25, 4) AS value FROM hub WHERE hub_type = 0", "hub")
def raster_values(spark, sf_dir):
    """Samples of a plane, which bilinear sampling gives back."""
    raster = spark.range(0, 40 * 40).select((F.col("id") % 40).alias("col"), F.floor(F.col("id") / 40).alias("row")).withColumn("value", 100.0 + 2 * F.col("col") + 3 * F.col("row"))
    points = view(spark, sf_dir, "hub").where("hub_type = 0").select(F.col("hub_id").alias("id"), "lon", "lat")
    return spatial.raster_samples(points, raster, 9.0, 46.0, 0.25).select("id", F.round("value", 4).alias("value"))


@query("SELECT cell AS cell_id, MAX(ele) - MIN(ele) AS spread_m FROM (SELECT rec % 40 AS cell, ele FROM vertex) v GROUP BY cell", "vertex")
def cell_spread(spark, sf_dir):
    return analysis.spread_by_cell(view(spark, sf_dir, "vertex").select((F.col("rec") % 40).alias("cell_id"), "ele"))


@query("SELECT COUNT(*) AS pairs, COUNT(*) FILTER (WHERE huts <> list_sort(huts)) AS substituted FROM tours", more=TOURLIKE_SQL)
def route_substitutions(spark, sf_dir):
    t = _tourlike(spark, sf_dir).select(F.col("tour").alias("source"), F.lit(0).alias("target"), F.col("huts").alias("nodes"))
    return analysis.substitutions(t, t.withColumn("nodes", F.array_sort("nodes")))


# Sources and runs


@query("SELECT hub_type, hub_id, CASE WHEN hub_id % 4 = 0 THEN upper(name) ELSE name END AS name FROM hub UNION ALL SELECT 9, hub_id, 'new' FROM hub WHERE hub_type = 0", "hub")
def hub_layers(spark, sf_dir):
    h = view(spark, sf_dir, "hub").select("hub_type", "hub_id", "name")
    return io.hubs(h, h.where("hub_id % 4 = 0").withColumn("name", F.upper("name")), h.where("hub_type = 0").select(F.lit(9).alias("hub_type"), "hub_id", F.lit("new").alias("name")))


@query("SELECT way_id FROM way WHERE (highway = 'path' AND surface = 'asphalt') OR (highway = 'track' AND access = 'yes')", "way")
def tag_filtered(spark, sf_dir):
    c = F.col
    return io.tag_filter(view(spark, sf_dir, "way"), [[c("highway") == "path", c("surface") == "asphalt"], [c("highway") == "track", c("access") == "yes"]]).select("way_id")


@query("SELECT CAST(x AS INT) AS lon, CAST(y AS INT) AS lat FROM (SELECT UNNEST(range(9, 17)) AS x) a CROSS JOIN (SELECT UNNEST(range(46, 49)) AS y) b")
def degree_tiles(spark, sf_dir):
    return io.tiles_over(9.5, 46.4, 16.2, 48.5, spark)


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1")
def fetch_queue(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return io.not_cached(c, c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 1, "ok").otherwise("error").alias("status")), "c_custkey")


@query("SELECT CAST(s_suppkey AS INT) AS s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey AS INT) END AS id, CAST(s_suppkey % 30 + s_nationkey AS INT) AS capacity, 47.25::DOUBLE AS lat, 11.5::DOUBLE AS lon, CASE WHEN s_suppkey % 4 = 0 THEN 'no id' END AS error FROM supplier")
def hut_info(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    places = lambda c: F.struct(c.cast("int").alias("totalSleepingPlaces"))
    body = F.to_json(F.struct(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey").cast("string")).otherwise("x").alias("hutId"), F.array(places(F.col("s_suppkey") % 30), places(F.col("s_nationkey"))).alias("hutBedCategories"), F.lit("47.25, 11.5").alias("coordinates")))
    return s.select(F.col("s_suppkey").cast("int").alias("s_suppkey"), io.info_fields(body).alias("i")).select("s_suppkey", "i.id", "i.capacity", "i.lat", "i.lon", "i.error")


@query("SELECT COUNT(*) AS records, COUNT(DISTINCT c_nationkey) AS geometries FROM customer")
def geometry_ids(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array(F.col("c_nationkey"), F.col("c_nationkey") + 1).alias("geometry"))
    records, geometries = io.geometry_once(c)
    return records.agg(F.count("*").alias("records")).join(geometries.agg(F.countDistinct("geometry_id").alias("geometries")))


@query("SELECT CAST(p_partkey AS BIGINT) AS task FROM part WHERE p_size % 3 <> 0 OR p_partkey % 5 = 0")
def stale_tasks(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("task"), F.col("p_size").alias("fingerprint"))
    return runs.stale(p, p.where("fingerprint % 3 = 0 AND task % 5 <> 0")).select("task")


@query("SELECT event_type AS phase, COUNT(*) AS runs, ROUND(MEDIAN(value), 6) AS median_s FROM events GROUP BY 1")
def phase_timings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return runs.timings(e.select(F.col("event_type").alias("phase"), F.col("ts").alias("at"), F.col("value").alias("seconds"))).select("phase", "runs", r6("median_s"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 5 < 3 THEN 1 ELSE 0 END AS usable FROM supplier")
def usable_trips(spark, sf_dir):
    """Stored trips, some without huts and some for too large a party."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("k", F.col("s_suppkey").cast("long"))
    one = F.struct(F.lit(1).alias("start_type"), F.col("k").alias("start_id"), F.col("k").alias("exit_id"), F.when(F.col("k") % 5 == 3, F.array().cast("array<bigint>")).otherwise(F.array("k")).alias("huts"), F.when(F.col("k") % 5 == 4, 99).otherwise(2).alias("party"))
    return s.select(F.col("k").alias("id"), F.size(io.read_trips(F.to_json(F.array(one)))).alias("usable"))


@query("SELECT hub_type, CAST(hub_id AS INT) AS hub_id, lon FROM hub", "hub")
def packed_roundtrip(spark, sf_dir):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return io.read_columns(*io.pack_columns(rows, {"hub_type": "i1", "hub_id": "u4", "lon": "f8"}))

    return view(spark, sf_dir, "hub").groupBy("hub_type").applyInPandas(run, "hub_type int, hub_id int, lon double")


# Map


@query(
    "SELECT tour, array_to_string(LIST(ROUND(lon, 5) || ' ' || ROUND(lat, 5) ORDER BY k), ',') AS points FROM (SELECT tour, 0 AS k, 1 + tour % 40 AS id, TRUE AS start FROM tours UNION ALL SELECT tour, i, huts[i], FALSE FROM (SELECT tour, huts, UNNEST(range(1, len(huts) + 1)) AS i FROM tours) t UNION ALL SELECT tour, 999, 1 + tour % 30, TRUE FROM tours) s LEFT JOIN place p ON p.start = s.start AND p.id = s.id GROUP BY tour HAVING COUNT(*) = COUNT(lon)",
    "hub",
    more="place AS (SELECT hub_type > 0 AS start, hub_id AS id, CAST(hub_id * 0.5 AS DOUBLE) AS lon, CAST(hub_id * 0.25 AS DOUBLE) AS lat FROM hub WHERE hub_type = 0 OR hub_id % 7 <> 0), " + TOURLIKE_SQL,
)
def tour_waypoints(spark, sf_dir):
    h = view(spark, sf_dir, "hub").where("hub_type = 0 OR hub_id % 7 <> 0")
    places = h.select(F.when(F.col("hub_type") == 0, "hut").otherwise("start").alias("kind"), F.col("hub_id").alias("id"), (F.col("hub_id") * 0.5).alias("lon"), (F.col("hub_id") * 0.25).alias("lat"))
    t = _tourlike(spark, sf_dir).select(F.col("tour").alias("tour_id"), "huts", (1 + F.col("tour") % 40).alias("start_id"), (1 + F.col("tour") % 30).alias("exit_start_id"))
    return mapping.waypoints(t, places).select(F.col("tour_id").alias("tour"), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", F.round(p["lon"], 5).cast("string"), F.round(p["lat"], 5).cast("string"))), ",").alias("points"))


ELEVATION_SQL = "leg AS (SELECT rec // 4 AS trip_id, rec AS leg, 1000.0 + rec % 500 AS distance_m, rec % 3 = 0 AS reversed, LIST(COALESCE(ele, 0.0) ORDER BY pos) AS profile FROM vertex GROUP BY rec)"


@query(
    "SELECT trip_id, leg, CAST(i - 1 AS INT) AS i, ROUND((start_m + CASE WHEN n > 1 THEN (i - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END * distance_m) / 1000, 6) AS km, CASE WHEN reversed THEN list_reverse(profile) ELSE profile END[i] AS ele FROM (SELECT *, len(profile) AS n, UNNEST(range(1, len(profile) + 1)) AS i FROM (SELECT *, COALESCE(SUM(distance_m) OVER (PARTITION BY trip_id ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM leg) l) e",
    "vertex",
    more=ELEVATION_SQL,
)
def trip_elevations(spark, sf_dir):
    profile = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ele", F.lit(0.0)).alias("e")))), lambda x: x["e"])
    rows = view(spark, sf_dir, "vertex").groupBy("rec").agg(profile.alias("profile"))
    rows = rows.select(F.floor(F.col("rec") / 4).alias("trip_id"), F.col("rec").alias("leg"), (1000.0 + F.col("rec") % 500).alias("distance_m"), (F.col("rec") % 3 == 0).alias("reversed"), "profile")
    return mapping.trip_elevation(rows).select("trip_id", "leg", "i", r6("km"), "ele")


KM_SQL = "leg AS (SELECT l_orderkey AS trip_id, pos AS leg, 500.0 + l_suppkey % 700 AS distance_m FROM (SELECT l_orderkey, l_suppkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_extendedprice) AS pos FROM lineitem) x), spans AS (SELECT *, SUM(distance_m) OVER (PARTITION BY trip_id ORDER BY leg) AS end_m, MAX(leg) OVER (PARTITION BY trip_id) AS last FROM leg)"


@query("SELECT s.trip_id, k.km, CAST(leg AS INT) AS leg, ROUND(LEAST((k.km * 1000 - end_m + distance_m) / distance_m, 1), 6) AS fraction FROM spans s JOIN (SELECT 0.3::DOUBLE AS km UNION ALL SELECT 1.7) k ON k.km * 1000 >= end_m - distance_m AND (k.km * 1000 < end_m OR leg = last)", more=KM_SQL)
def legs_at_km(spark, sf_dir):
    view(spark, sf_dir, "hub")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_extendedprice"))
    rows = spark.table("lineitem").select(F.col("l_orderkey").alias("trip_id"), pos.alias("leg"), (500.0 + F.col("l_suppkey") % 700).alias("distance_m"))
    kilometres = rows.select("trip_id").distinct().withColumn("km", F.explode(F.array(F.lit(0.3).cast("double"), F.lit(1.7).cast("double"))))
    return polyline.leg_at(rows, kilometres).select("trip_id", "km", "leg", r6("fraction"))


@query(
    "SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(ascent_m AS INT) AS ascent_m, CASE WHEN sac_rank >= 0 THEN sac_rank END AS sac_rank, CASE WHEN from_id % 3 = 0 THEN 'private' END AS access FROM hut_edge",
    "hut_edge",
)
def edge_stats(spark, sf_dir):
    e = view(spark, sf_dir, "hut_edge")
    tags = e.select(F.col("from_id").alias("start_id")).distinct().where("start_id % 3 = 0").withColumn("access", F.lit("private"))
    got = mapping.tile_stats(e.withColumnRenamed("from_id", "start_id"), tags)
    field = lambda n, t: F.get_json_object("stats", f"$.{n}").cast(t).alias(n)
    return got.select("edge_id", F.get_json_object("stats", "$.ascent_m").cast("double").cast("int").alias("ascent_m"), field("sac_rank", "int"), field("access", "string"))


@query(
    "SELECT t.tour AS tour_id, COALESCE(a.name, '?') || ' – ' || COALESCE(b.name, '?') AS name, CAST(1 + t.tour % 2 AS INT) AS start_type, CAST(3 AS INT) AS party FROM tours t LEFT JOIN (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0) a ON a.id = t.huts[1] LEFT JOIN (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0) b ON b.id = t.huts[-1] WHERE t.tour % 11 <> 0",
    more=TOURLIKE_SQL,
)
def tour_trips(spark, sf_dir):
    t = _tourlike(spark, sf_dir).select(F.col("tour").alias("tour_id"), "huts", F.col("tour").alias("start_id"), F.col("tour").alias("exit_start_id"))
    starts = t.where("tour_id % 11 <> 0").select("start_id", (1 + F.col("start_id") % 2).cast("int").alias("start_type"))
    huts = spark.table("supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("hut_id"), F.col("s_name").alias("name"))
    return mapping.as_trips(t, starts, huts, None, 3).select("tour_id", "name", "start_type", "party")


@query(f"SELECT hub_type, hub_id, name, ROUND(lon, 6) AS lon FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY hub_type, hub_id) AS k FROM (SELECT hub_type, hub_id, 'n' || (hub_id % 60) AS name, lon FROM hub) h) f WHERE k = 1", "hub")
def first_of_names(spark, sf_dir):
    h = view(spark, sf_dir, "hub").withColumn("name", F.concat(F.lit("n"), (F.col("hub_id") % 60).cast("string")))
    return grading.first_by_key(h, ["name"], [F.col("hub_type"), F.col("hub_id")]).select("hub_type", "hub_id", "name", r6("lon"))
