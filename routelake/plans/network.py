"""Queries of the app's joins, cells, chains and specifications, and SQL for queries that had none."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelake.fixtures import view, with_views
from routelake.functions import geo
from routelake.operators import analysis, app, graph, legs, mapping, polyline, search, spatial, study
from routelake.sources import io
from routelake.plans.lineage import cut
from routelake.plans.more import EDGES
from routelake.plans.queries import BOX, CELL_SQL, CHAIN_SQL, FACTS_SQL, LEGS_SQL, MASK_SQL, ORACLES, SEARCH_SQL, PAIR_M, POINTS_SQL, TILE_KM, TOURLIKE_SQL, VARIANT_SQL, _facts, _huts, _scarce, _tourlike, din, hav, query, r6
from routelake.schema import HUT, PARTNER

# The app's joins

CLASS_SQL = "classed AS (SELECT hub_id, name, lon, lat, CASE WHEN hub_id % 3 = 0 THEN 'av' ELSE 'sonstige' END AS operator, hub_id % 4 <> 1 AS serviced FROM hub WHERE hub_type = 0)"


def _classed(spark, sf_dir):
    h = view(spark, sf_dir, "hub").where("hub_type = 0")
    return h.select("hub_id", "name", "lon", "lat", F.when(F.col("hub_id") % 3 == 0, "av").otherwise("sonstige").alias("operator"), (F.col("hub_id") % 4 != 1).alias("serviced"))


@query("SELECT hub_id, operator || ':' || CASE WHEN serviced THEN 'serviced' ELSE 'self' END AS key, CASE operator WHEN 'av' THEN 'Alpenverein' ELSE 'Sonstige' END || CASE WHEN serviced THEN '' ELSE ' (Selbstversorger)' END AS label, CASE operator WHEN 'av' THEN 'AV' ELSE 'SO' END AS badge FROM classed", "hub", more=CLASS_SQL)
def hut_class_labels(spark, sf_dir):
    o, s = F.col("operator"), F.col("serviced")
    return _classed(spark, sf_dir).select("hub_id", app.class_key(o, s).alias("key"), app.class_label(o, s).alias("label"), app.class_badge(o).alias("badge"))


@query("SELECT 'hut' AS layer, 'g' || hub_id AS key, CASE WHEN hub_id % 20 IN (8, 5, 3) THEN 'av' ELSE 'sonstige' END AS kind FROM hub WHERE hub_type = 0 AND hub_id % 6 <> 0 AND (hub_id % 10 IN (2, 6) OR hub_id % 20 NOT IN (19, 9, 17, 16)) UNION ALL SELECT 'partner', CAST(hub_id AS VARCHAR), 'partner' FROM hub WHERE hub_type = 0 AND hub_id % 10 NOT IN (2, 6) AND hub_id % 20 IN (19, 9, 17, 16)", "hub")
def huts_and_partners(spark, sf_dir):
    k = F.col("hub_id")
    features = view(spark, sf_dir, "hub").where("hub_type = 0").select(
        k.alias("object_id"), F.when(k % 6 != 0, F.concat(F.lit("g"), k.cast("string"))).alias("guid"), "name", ((k % 10) * 10).alias("category"), (k % 20).alias("club"), F.lit(None).cast("double").alias("elevation"), k.alias("ohrs_id"), "lon", "lat"
    )
    huts, partners = app.huts_and_partners(features)
    return huts.select(F.lit("hut").alias("layer"), F.col("guid").alias("key"), F.col("hut_type").alias("kind")).unionByName(partners.select(F.lit("partner").alias("layer"), F.col("object_id").cast("string").alias("key"), F.lit("partner").alias("kind")))


@query("SELECT p.pos, 'g' || p.id AS guid, h.name FROM (SELECT DISTINCT l_suppkey * 2 AS id, l_suppkey AS pos FROM lineitem) p LEFT JOIN hub h ON h.hub_type = 0 AND h.hub_id = p.id", "hub")
def resolved_huts(spark, sf_dir):
    h = view(spark, sf_dir, "hub").where("hub_type = 0").select(F.concat(F.lit("g"), F.col("hub_id").cast("string")).alias("guid"), "name")
    ids = spark.table("lineitem").select(F.col("l_suppkey").alias("pos"), F.concat(F.lit("g"), (F.col("l_suppkey") * 2).cast("string")).alias("guid")).distinct()
    return app.resolved(ids, h)


@query("SELECT id AS start_id, ARG_MAX(t, k) AS start_type, ARG_MAX(name, k) AS name FROM (SELECT hub_id // 2 AS id, CAST(hub_type AS INT) AS t, name, hub_type AS k FROM hub WHERE hub_type > 0 AND hub_id % 2 = 0 UNION ALL SELECT hub_id // 3, CAST(7 AS INT), 'late', 9 FROM hub WHERE hub_type = 2 AND hub_id % 3 = 0) s GROUP BY id", "hub")
def start_registry(spark, sf_dir):
    h, layer = view(spark, sf_dir, "hub"), lambda rows, k: rows.withColumn("start_id", F.floor(F.col("hub_id") / k))
    by_type = [layer(h.where((F.col("hub_type") == t) & (F.col("hub_id") % 2 == 0)), 2).withColumn("start_type", F.lit(t)) for t in (1, 2, 3)]
    late = layer(h.where("hub_type = 2 AND hub_id % 3 = 0"), 3).withColumns({"start_type": F.lit(7), "name": F.lit("late")})
    unknown = late.withColumns({"start_id": F.lit(None).cast("long"), "name": F.lit("unknown")})
    return app.start_index(*by_type, late, unknown).select("start_id", "start_type", "name")


@query("SELECT hub_id AS hut_id, 3.5::DOUBLE AS min_h, 7.0::DOUBLE AS max_h, 900.0::DOUBLE AS ascent, CAST(NULL AS DOUBLE) AS top FROM classed WHERE (operator = 'av' AND serviced) OR (operator = 'sonstige' AND NOT serviced)", "hub", more=CLASS_SQL)
def form_query(spark, sf_dir):
    form = {"mode": "transit", "classes": {"av:serviced", "sonstige:self"}, "leg_hours": 7.0, "leg_ascent": "900", "greatest_height": "", "via_ferrata": True}
    q = app.query_of(form, _classed(spark, sf_dir).withColumnRenamed("hub_id", "hut_id"), (2, 3))
    return q.allowed.select("hut_id", *[F.lit(v).cast("double").alias(n) for n, v in (("min_h", q.min_leg_h), ("max_h", q.max_leg_h), ("ascent", q.ascent_cap), ("top", q.max_ele))])


@query(
    f"SELECT m.start_id, m.hut_id, e.start_id AS exit_start_id, ROUND(m.h + e.h, 6) AS total_h FROM (SELECT start_id, hut_id, MIN(h) AS h FROM matrix WHERE start_type = 1 AND h BETWEEN 3.5 AND 7 GROUP BY 1, 2) m JOIN exits e ON e.hut_id = m.hut_id JOIN classed c ON c.hub_id = m.hut_id JOIN hub s ON s.hub_type > 0 AND s.hub_id = m.start_id WHERE e.h BETWEEN 3.5 AND 7 AND c.operator = 'av' AND m.hut_id % 5 <> 2 AND s.lon BETWEEN 11 AND 14",
    "start_record",
    "hut_edge",
    "hub",
    more=SEARCH_SQL.replace("{most}", "1") + ", " + CLASS_SQL,
)
def discovered(spark, sf_dir):
    """A form's tours of one night from starts on the map, without those whose night is full."""
    s = view(spark, sf_dir, "start_record")
    m = legs.approach_matrix(s)
    form = {"mode": "transit", "classes": {"av:serviced", "av:self"}, "leg_hours": 7.0, "via_ferrata": True}
    q = app.query_of(form, _classed(spark, sf_dir).withColumnRenamed("hub_id", "hut_id"), (2, 2))
    tours, _ = search.search(q, m, legs.loop_closure(s, m), legs.adjacency(view(spark, sf_dir, "hut_edge")))
    tours = tours.withColumn("tour_id", F.concat_ws("-", "place"))
    beds = view(spark, sf_dir, "hub").where("hub_type = 0 AND hub_id % 5 = 2").select(F.col("hub_id").alias("hut_id"), F.lit(1).alias("night"), F.lit(False).alias("free"))
    places = tours.join(view(spark, sf_dir, "hub").where("hub_type > 0").select(F.col("hub_id").alias("start_id"), "lon", "lat"), "start_id").select("tour_id", "lon", "lat")
    _, listed = app.visible(tours, beds, search.fit_score(2, (2, 2), (3.5, 7.0)), "duration", places=places, box=(11.0, 0.0, 14.0, 90.0))
    return listed.select("start_id", F.element_at("huts", 1).alias("hut_id"), "exit_start_id", r6("total_h"))


@query(
    "SELECT e.edge_id, CASE WHEN h.lon IS NOT NULL AND e.edge_id % 4 <> 3 THEN ROUND(h.lat + (e.edge_id % 50 + CASE WHEN e.edge_id % 3 = 0 THEN 0 ELSE 100 END) * 1e-4, 6) END AS lat, CASE WHEN h.lon IS NOT NULL AND e.edge_id % 4 <> 3 THEN ROUND(h.lon - 7e-4, 6) END AS lon FROM start_record e LEFT JOIN hub h ON h.hub_type = 0 AND h.hub_id = e.hut_id AND h.hub_id % 7 <> 0 WHERE e.variant = 0",
    "start_record",
    "hub",
)
def anchors_of_legs(spark, sf_dir):
    """Anchors from the approach row of every third edge, from the exits' rows else; some have none."""
    e, k = view(spark, sf_dir, "start_record").where("variant = 0"), F.col("edge_id")
    row = lambda plus: F.array((k % 50 + plus).cast("smallint"), F.lit(-7).cast("smallint")).alias("offsets")
    exits = e.where(k % 4 != 3).select("edge_id", "hut_id", row(100))
    approaches = e.where((k % 4 != 3) & (k % 3 == 0)).select("edge_id", "hut_id", row(0))
    huts = view(spark, sf_dir, "hub").where("hub_type = 0 AND hub_id % 7 != 0").select(F.col("hub_id").alias("hut_id"), "lon", "lat")
    got = app.leg_anchors(e.select("edge_id"), approaches, exits, huts)
    return got.select("edge_id", F.round(F.get("anchors", F.lit(0))["lat"], 6).alias("lat"), F.round(F.get("anchors", F.lit(0))["lon"], 6).alias("lon"))


@query("SELECT o_orderkey, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 AS INT)) + 1 AS INT) AS days FROM orders")
def day_counts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", app.day_count(F.col("d"), F.date_add("d", (F.col("o_custkey") % 9).cast("int"))).alias("days"))


@query("SELECT 't' || tour AS id, 'Tour ' || tour AS name, '2026-06-01' AS created, '2026-06-01' AS updated, CAST(len(huts) AS INT) AS nights, CAST(2 AS INT) AS party FROM tours", more=TOURLIKE_SQL)
def new_trips(spark, sf_dir):
    t = F.col("tour").cast("string")
    one = app.new_trip(F.concat(F.lit("t"), t), F.concat(F.lit("Tour "), t), F.lit("2026-06-01"), F.struct(F.lit(1).alias("startId")), F.col("huts"), F.struct(F.lit(1).alias("startId")), F.lit(None).cast("string"), F.lit(2))
    return _tourlike(spark, sf_dir).select(one.alias("t")).select("t.id", "t.name", F.col("t.createdAt").alias("created"), F.col("t.updatedAt").alias("updated"), F.size("t.huts").alias("nights"), F.col("t.partySize").alias("party"))


@query("SELECT UNNEST(['a25_dlat', 'a25_dlng', 'a50_dlat', 'a50_dlng', 'a75_dlat', 'a75_dlng']) AS name")
def anchor_columns(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in app.anchor_names(3)], "name string")


# Cells, boxes, chains

_STEP, _COLS, _ROWS = geo.grid_shape(*BOX, TILE_KM)
_LON = _STEP / geo._cosine((BOX[1] + BOX[3]) / 2)


@query(
    f"SELECT c.cell AS cell_id, h.hub_type, h.hub_id, h.hub_type = 0 AND h.cell = c.cell AS is_hut FROM (SELECT DISTINCT {CELL_SQL} AS cell FROM hub WHERE hub_type = 0) c JOIN (SELECT *, {CELL_SQL} AS cell FROM hub) h ON h.lon BETWEEN {BOX[0]} + (c.cell % {_COLS} - 0.5) * {_LON!r} AND {BOX[0]} + (c.cell % {_COLS} + 1.5) * {_LON!r} AND h.lat BETWEEN {BOX[1]} + (c.cell // {_COLS} - 0.5) * {_STEP!r} AND {BOX[1]} + (c.cell // {_COLS} + 1.5) * {_STEP!r}",
    "hub",
)
def hub_candidates(spark, sf_dir):
    return graph.candidate_hubs(view(spark, sf_dir, "hub"), BOX, TILE_KM, TILE_KM / 2)


@query("SELECT 'edge' AS kind, edge_id AS id FROM hut_edge WHERE from_id IN (SELECT id FROM ins) OR to_id IN (SELECT id FROM ins) UNION ALL SELECT 'node', id FROM (SELECT id FROM ins UNION SELECT from_id FROM hut_edge WHERE to_id IN (SELECT id FROM ins) UNION SELECT to_id FROM hut_edge WHERE from_id IN (SELECT id FROM ins)) n", "hub", "hut_edge", more="ins AS (SELECT hub_id AS id FROM hub WHERE hub_type = 0 AND lon BETWEEN 11 AND 13 AND lat BETWEEN 46.8 AND 47.9)")
def clipped_box(spark, sf_dir):
    nodes = view(spark, sf_dir, "hub").where("hub_type = 0").select(F.col("hub_id").alias("node_id"), "lon", "lat")
    edges = view(spark, sf_dir, "hut_edge").select("edge_id", F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    n, e = graph.clipped(nodes, edges, (11.0, 46.8, 13.0, 47.9))
    return n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


@query(
    "SELECT MIN(seg_id) AS chain, CAST(COUNT(*) AS INT) AS segs, SUM(length_m) AS length_m, CAST(SUM(seg_id % 70 + seg_id % 40) AS DOUBLE) AS climbs FROM (SELECT s.*, g.low FROM segs s JOIN (SELECT u, MIN(label) AS low FROM reach GROUP BY u) g ON g.u = s.seg_id) l GROUP BY low",
    more="RECURSIVE segs AS (" + CHAIN_SQL.replace(" AS DOUBLE) AS length_m", " AS DOUBLE) AS length_m") + "), ends AS (SELECT seg_id, u AS node FROM segs UNION ALL SELECT seg_id, v FROM segs), two AS (SELECT node FROM ends GROUP BY node HAVING COUNT(*) = 2), meets AS (SELECT a.seg_id AS a, b.seg_id AS b FROM ends a JOIN ends b ON a.node = b.node JOIN two ON two.node = a.node), reach AS (SELECT seg_id AS u, seg_id AS label FROM segs UNION SELECT r.u, m.b FROM reach r JOIN meets m ON m.a = r.label)",
)
def chains_in_order(spark, sf_dir):
    """Chains of the sparse network; what does not depend on the direction of the walk."""
    view(spark, sf_dir, "hub")
    s = spark.sql(CHAIN_SQL).select("seg_id", "u", "v", "length_m", (F.col("seg_id") % 70).cast("double").alias("ascent_m"), (F.col("seg_id") % 40).cast("double").alias("descent_m"))
    return graph.ordered_chains(s).select(F.array_min("seg_ids").alias("chain"), F.size("seg_ids").alias("segs"), "length_m", (F.col("ascent_m") + F.col("descent_m")).alias("climbs"))


@query("SELECT cell_id, score, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, cell_id) AS INT) AS place FROM (SELECT e.cell_id, e.n * COALESCE(h.n, 1) AS score FROM (SELECT from_id % 12 AS cell_id, COUNT(*) AS n FROM hut_edge GROUP BY 1) e LEFT JOIN (SELECT hub_id % 12 AS cell_id, COUNT(*) AS n FROM hub WHERE hub_type = 0 AND hub_id % 5 = 0 GROUP BY 1) h ON h.cell_id = e.cell_id) s", "hub", "hut_edge")
def cell_workload(spark, sf_dir):
    hubs = view(spark, sf_dir, "hub").where("hub_type = 0").select((F.col("hub_id") % 12).alias("cell_id"), (F.col("hub_id") % 5 == 0).alias("is_hut"))
    return graph.by_workload(view(spark, sf_dir, "hut_edge").select((F.col("from_id") % 12).alias("cell_id")), hubs)


@query("SELECT c_custkey AS key, COALESCE(array_to_string(LIST(i * 3 ORDER BY i) FILTER (WHERE i IS NOT NULL), ' '), '') AS vals FROM (SELECT c_custkey, UNNEST(CASE WHEN c_custkey % 4 = 0 THEN [NULL] ELSE range(c_custkey % 50, c_custkey % 50 + c_custkey % 4) END) AS i FROM customer) r GROUP BY c_custkey")
def gathered_runs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 50).cast("long").alias("start"), (F.col("c_custkey") % 4).cast("long").alias("n"))
    flat = spark.range(60).select(F.col("id").alias("i"), (F.col("id") * 3).alias("value"))
    return graph.gathered(c, flat).select("key", F.array_join(F.col("values").cast("array<string>"), " ").alias("vals"))


@query(
    f"SELECT DISTINCT w.way_id FROM way w JOIN (SELECT h.hub_id FROM hub h JOIN (VALUES {', '.join(f'({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)' for a, b, c, d in EDGES)}) r(x1, y1, x2, y2) ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 WHERE hub_type = 1 GROUP BY h.hub_id HAVING COUNT(*) % 2 = 1) i ON i.hub_id // 3 = w.way_id WHERE w.highway IN ('path', 'track')",
    "way",
    "hub",
)
def trails_in_region(spark, sf_dir):
    """Ways with stations as their points."""
    points = view(spark, sf_dir, "hub").where("hub_type = 1").select(F.floor(F.col("hub_id") / 3).alias("way_id"), F.col("hub_id").alias("pos"), "lon", "lat")
    ways = view(spark, sf_dir, "way").select("way_id", "highway")
    return spatial.trails(ways.unionByName(ways), points, spark.createDataFrame(EDGES, "x1 double, y1 double, x2 double, y2 double"), ["path", "track"]).select("way_id")


@query(f"SELECT hub_id, CAST(k AS INT) AS k, ROUND(lon + 30000 / {geo.DEGREE_M!r} * SIN(2 * PI() * k / 32) / COS(RADIANS(lat)), 6) AS lon, ROUND(lat + 30000 / {geo.DEGREE_M!r} * COS(2 * PI() * k / 32), 6) AS lat FROM hub, UNNEST(range(0, 33)) t(k) WHERE hub_type = 0", "hub")
def range_circles(spark, sf_dir):
    h = view(spark, sf_dir, "hub").where("hub_type = 0")
    return h.select("hub_id", F.posexplode(geo.circle_ring(F.col("lon"), F.col("lat"), 30.0)).alias("k", "p")).select("hub_id", "k", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query(
    f"SELECT start_id, hub_type, hub_id FROM (SELECT s.hub_id AS start_id, h.hub_type, h.hub_id, ROW_NUMBER() OVER (PARTITION BY s.hub_id ORDER BY h.hub_type <> 0, {hav('s.lon', 's.lat', 'h.lon', 'h.lat')}, h.hub_type, h.hub_id) AS k FROM hub s JOIN hub h ON s.hub_type = 1 AND h.hub_type IN (0, 3) WHERE {hav('s.lon', 's.lat', 'h.lon', 'h.lat')} <= {PAIR_M}) n WHERE k = 1",
    "hub",
)
def nearest_hub_huts_first(spark, sf_dir):
    """The hut nearest to each station, or where none is in range the nearest partner."""
    h = view(spark, sf_dir, "hub")
    stations = h.where("hub_type = 1").select(F.col("hub_id").alias("start_id"), "lon", "lat")

    def found(points, kind):
        others = h.where(F.col("hub_type") == kind).select("hub_type", F.col("hub_id").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
        return spatial.nearest(points, others, PAIR_M, ["start_id"], ["other"], copy="right").select("start_id", "hub_type", F.col("other").alias("hub_id"))

    by_hut = cut(found(stations, HUT))
    return by_hut.unionByName(found(stations.join(by_hut, "start_id", "left_anti"), PARTNER))


@query("SELECT tour, CAST(i - 1 AS INT) AS leg, huts[i] AS prev, huts[i + 1] AS next FROM (SELECT tour, huts, UNNEST(range(1, len(huts))) AS i FROM tours) t", more=TOURLIKE_SQL)
def trip_stops(spark, sf_dir):
    chains = _tourlike(spark, sf_dir).where("size(huts) > 1").select(F.col("tour").alias("edge_id"), F.element_at("huts", 1).alias("u_point"), F.element_at("huts", -1).alias("v_point"), F.slice("huts", F.lit(2), F.size("huts") - 2).alias("interior"))
    return graph.raw_segments(chains).select(F.col("edge_id").alias("tour"), F.col("pos").alias("leg"), F.col("a").alias("prev"), F.col("b").alias("next"))


@query("SELECT tier, CAST(row0 AS INT) AS row, CAST(col0 AS INT) AS col, value FROM (SELECT 0 AS tier, hub_id % 9 AS row0, hub_id % 11 AS col0, MIN(CASE WHEN hub_type = 0 THEN lon END) AS a, MIN(CASE WHEN hub_type = 2 THEN lat END) AS b FROM hub GROUP BY 2, 3) m, LATERAL (SELECT COALESCE(b, a) AS value) v WHERE value IS NOT NULL", "hub")
def raster_mosaic(spark, sf_dir):
    """Two overlapping rasters, the later of which wins where it has values."""
    h, cell = view(spark, sf_dir, "hub"), lambda c: c.cast("int")
    part = lambda t, rank, value: h.where(F.col("hub_type") == t).groupBy(cell(F.col("hub_id") % 9).alias("row"), cell(F.col("hub_id") % 11).alias("col")).agg(F.min(value).alias("value")).withColumn("priority", F.lit(rank))
    return spatial.mosaic(part(0, 0, "lon").unionByName(part(2, 1, "lat"))).select(F.lit(0).alias("tier"), "row", "col", "value")


@query(
    "SELECT COUNT(*) AS edges, ROUND(SUM(total_m) / 1000, 3) AS total_km, ROUND(SUM(explicit_m) / 1000, 3) AS explicit_km, ROUND(SUM(ungraded_m) / 1000, 3) AS ungraded_km, COUNT(*) FILTER (WHERE ungraded_m <= 0) AS fully_graded, ROUND(QUANTILE_CONT(ungraded_m / GREATEST(total_m, 1.0), 0.5), 6) AS median FROM lines",
    "hut_edge",
    more="lines AS (SELECT distance_m AS total_m, distance_m * (edge_id % 3) / 3 AS explicit_m, CASE WHEN edge_id % 3 = 2 THEN 0 ELSE distance_m / 3 END AS ungraded_m FROM hut_edge)",
)
def attribution_totals(spark, sf_dir):
    e, k = view(spark, sf_dir, "hut_edge"), F.col("edge_id") % 3
    zero = F.lit(0.0)
    lines = e.select(F.col("distance_m").alias("total_m"), (F.col("distance_m") * k / 3).alias("explicit_m"), zero.alias("inferred_m"), F.when(k == 2, 0.0).otherwise(F.col("distance_m") / 3).alias("ungraded_m"), zero.alias("excluded_m"), zero.alias("unmatched_m"))
    got = analysis.attribution_summary(lines)
    return got.select("edges", *[F.round(c, 3).alias(c) for c in ("total_km", "explicit_km", "ungraded_km")], "fully_graded", F.round(F.col("ungraded_share")[analysis.PERCENTILES[2:].index(0.5)], 6).alias("median"))


@query("SELECT status, COUNT(*) AS days, COUNT(*) FILTER (WHERE free_place <= 15) AS scarce FROM hut_day GROUP BY status", "hut_day")
def status_counts(spark, sf_dir):
    return view(spark, sf_dir, "hut_day").groupBy("status").agg(F.count("*").alias("days"), F.count_if(F.col("free_place") <= 15).alias("scarce"))


NODE_SQL = "node AS (SELECT hub_id AS node_id, lon + 0.0004 * (hub_id % 5) AS lon, lat, 1000.0 + (hub_id * 17) % 60 AS ele FROM hub WHERE hub_type = 0)"


@query(
    f"SELECT hub_id, CASE WHEN reason IS NULL THEN 'node' ELSE 'rejected' END AS kind, node_id, ROUND(gap, 3) AS gap_m, dz AS dz_m, reason FROM (SELECT *, CASE WHEN node_id IS NULL THEN 'gap_too_far' WHEN ABS(dz) > 25 THEN 'vertical_offset' END AS reason FROM (SELECT h.hub_id, n.node_id, n.gap, n.ele - 1020.0 AS dz, ROW_NUMBER() OVER (PARTITION BY h.hub_id ORDER BY n.gap, n.node_id) AS k FROM hub h LEFT JOIN (SELECT b.hub_id, a.*, {hav('b.lon', 'b.lat', 'a.lon', 'a.lat')} AS gap FROM node a JOIN hub b ON b.hub_type = 0 AND {hav('b.lon', 'b.lat', 'a.lon', 'a.lat')} <= 100) n ON n.hub_id = h.hub_id WHERE h.hub_type = 0) o WHERE k = 1) s",
    "hub",
    more=NODE_SQL,
)
def hub_snaps(spark, sf_dir):
    """Huts on the nodes beside them, of which some lie too far off or too high."""
    h, k = view(spark, sf_dir, "hub").where("hub_type = 0"), F.col("hub_id")
    nodes = h.select(k.alias("node_id"), (F.col("lon") + 0.0004 * (k % 5)).alias("lon2"), F.col("lat").alias("lat2"), (1000.0 + (k * 17) % 60).alias("ele2"))
    segments = spark.createDataFrame([], "edge_id long, seg int, lon_a double, lat_a double, lon_b double, lat_b double, ele_a double, ele_b double")
    return spatial.snap(h.select("hub_type", "hub_id", "lon", "lat", F.lit(1020.0).cast("double").alias("ele")), nodes, segments).select("hub_id", "kind", "node_id", F.round("gap_m", 3).alias("gap_m"), "dz_m", "reason")


@query(
    "SELECT edge_id AS tour_id, ROUND(a.lon + (b.lon - a.lon) * t, 6) AS lon, ROUND(a.lat + (b.lat - a.lat) * t, 6) AS lat, CASE WHEN b.lon < a.lon THEN 'west' ELSE 'east' END AS heading, CAST(r AS INT) AS rank FROM hut_edge JOIN hub a ON a.hub_type = 0 AND a.hub_id = from_id JOIN hub b ON b.hub_type = 0 AND b.hub_id = to_id CROSS JOIN (VALUES (0.25::DOUBLE, 2), (0.5::DOUBLE, 1), (0.75::DOUBLE, 3)) f(t, r)",
    "hut_edge",
    "hub",
)
def leg_anchor_points(spark, sf_dir):
    """Anchors of single legs along their chords."""
    h = view(spark, sf_dir, "hub").where("hub_type = 0")
    end = lambda name: h.select(F.col("hub_id").alias(f"{name}_id"), F.col("lon").alias(f"{name}_lon"), F.col("lat").alias(f"{name}_lat"))
    e = view(spark, sf_dir, "hut_edge").join(end("from"), "from_id").join(end("to"), "to_id")
    rows = e.select(F.col("edge_id").alias("tour_id"), F.lit(0).alias("leg"), "distance_m", F.lit(False).alias("reversed"), F.lit(None).cast("array<struct<lon: double, lat: double>>").alias("anchors"), "from_lon", "from_lat", "to_lon", "to_lat")
    return mapping.anchors(rows, (0.0, 0.0, 90.0, 90.0)).select("tour_id", r6("lon"), r6("lat"), "heading", "rank")


POLY = "region\n1\n 10.0 46.5\n 14.0 46.5\n 14.0 48.0\nEND\n!2\n 12.0 46.8\n 12.5 46.8\n 12.5 47.0\nEND\nEND\n"


@query("SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM (VALUES (10.0, 46.5, 14.0, 46.5), (14.0, 46.5, 14.0, 48.0), (14.0, 48.0, 10.0, 46.5), (12.0, 46.8, 12.5, 46.8), (12.5, 46.8, 12.5, 47.0), (12.5, 47.0, 12.0, 46.8)) r(x1, y1, x2, y2)")
def region_rings(spark, sf_dir):
    return spark.createDataFrame(io.ring_edges(POLY), "x1 double, y1 double, x2 double, y2 double")


@query("SELECT rec, CAST(SUM(m) AS BIGINT) AS len_m, COUNT(*) > 1 AS several FROM (SELECT rec, 100 + pos * 7 AS m FROM vertex) v GROUP BY rec", "vertex")
def merged_runs(spark, sf_dir):
    """Runs of at least 300 m out of short segments: the lengths are kept, and only the last run may be short."""
    segs = F.transform(F.array_sort(F.collect_list(F.col("pos"))), lambda p: F.struct((100.0 + p * 7).alias("len"), F.lit(1.0).alias("dz")))
    lines = view(spark, sf_dir, "vertex").groupBy("rec").agg(segs.alias("segs")).withColumn("n", F.size("segs"))
    got = polyline.merged_segments(lines, 300.0)
    sound = F.forall(F.slice("segs", F.lit(1), F.size("segs") - 1), lambda s: s["len"] >= 300)
    total = F.aggregate("segs", F.lit(0.0), lambda a, s: a + s["len"])
    return got.where(sound).select("rec", total.cast("long").alias("len_m"), (F.col("n") > 1).alias("several"))


# Study


@query(f"SELECT COUNT(*) AS n, ROUND(MEDIAN(km), 3) AS median, ROUND(MAX(km), 3) AS max FROM ({ORACLES['controls_topk']}) t")
def control_distances(spark, sf_dir):
    t = _huts(spark, sf_dir)
    found = study.controls(t.where("tour > 0").withColumnRenamed("ohrs_id", "b").select("b", "elevation", "capacity", "lon", "lat"), t.where("tour = 0"), 0.4)
    units = found.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("km", "hut"))).alias("controls"))
    return study.control_distances(units).select("n", F.round("median", 3).alias("median"), F.round("max", 3).alias("max"))


GRID_SQL = (
    "cuts AS (SELECT f.*, c.cut, CASE c.cut WHEN 'season' THEN TRUE WHEN 'jul_aug' THEN MONTH(d) IN (7, 8) ELSE ISODOW(d) >= 5 END AS hit FROM facts f CROSS JOIN (VALUES ('season'), ('jul_aug'), ('fri_sun')) c(cut)), "
    "season AS (SELECT ohrs_id, CAST(YEAR(d) AS INT) AS season, cut, COUNT(*) FILTER (WHERE open) >= 14 AS eligible, COALESCE(MIN(free_place) FILTER (WHERE open) = MAX(free_place) FILTER (WHERE open) AND MAX(free_place) FILTER (WHERE open) <> 0, FALSE) AS no_activity, COALESCE(BOOL_OR(open AND above), FALSE) AS mismatch, "
    "AVG(occupancy) FILTER (WHERE open AND hit) AS occupancy, COUNT(*) FILTER (WHERE open AND hit) AS n, COUNT(*) FILTER (WHERE open AND hit AND sold_out) AS so, COUNT(*) FILTER (WHERE open AND hit AND sold_out_near) AS sn FROM cuts GROUP BY 1, 2, 3), "
    "rows AS (SELECT season || '|' || cut || '|' || outcome || '|' || variant AS spec, ohrs_id % 2 AS tour, value FROM (SELECT s.*, v.variant, o.outcome, CASE o.outcome WHEN 'occupancy' THEN occupancy WHEN 'sold_out' THEN so / CAST(NULLIF(n, 0) AS DOUBLE) ELSE sn / CAST(NULLIF(n, 0) AS DOUBLE) END AS value FROM season s CROSS JOIN (VALUES ('primary'), ('incl_no_activity'), ('incl_mismatch')) v(variant) CROSS JOIN (VALUES ('occupancy'), ('sold_out'), ('sold_out_near')) o(outcome) WHERE eligible AND (NOT no_activity OR variant = 'incl_no_activity') AND (NOT mismatch OR variant = 'incl_mismatch')) x WHERE value IS NOT NULL), "
    "sums AS (SELECT spec, COUNT(*) FILTER (WHERE tour = 1) AS n1, COUNT(*) FILTER (WHERE tour = 0) AS n0, AVG(value) FILTER (WHERE tour = 1) AS m1, AVG(value) FILTER (WHERE tour = 0) AS m0, STDDEV_SAMP(value) AS sd FROM rows GROUP BY spec)"
)


@query("SELECT spec, n1 AS n_tour, n0 AS n_other, CASE WHEN LEAST(n1, n0) >= 5 THEN ROUND(m1, 6) END AS mean_tour, CASE WHEN LEAST(n1, n0) >= 5 THEN ROUND(m0, 6) END AS mean_other, CASE WHEN LEAST(n1, n0) >= 5 THEN ROUND(sd, 6) END AS sd, CASE WHEN LEAST(n1, n0) < 5 THEN 'group too small (' || n1 || ' tour / ' || n0 || ' other)' END AS skipped FROM sums", "hut_day", more=FACTS_SQL + ", " + GRID_SQL)
def specification_grid(spark, sf_dir):
    on_tour = view(spark, sf_dir, "hut_day").select("ohrs_id").distinct().withColumn("tour", (F.col("ohrs_id") % 2).cast("int"))
    got = study.specifications(study.specification_rows(_scarce(_facts(spark, sf_dir)), on_tour))
    return got.select("spec", "n_tour", "n_other", r6("mean_tour"), r6("mean_other"), r6("sd"), "skipped")


# SQL of queries that had none

ORACLES["tour_search_car"] = with_views(
    "SELECT b.start_id, b.start_id AS exit_start_id, array_to_string(b.huts, '>') AS huts, ROUND(b.total + e.h, 6) AS total_h FROM (SELECT start_id, last, ARG_MIN(huts, total) AS huts, MIN(total) AS total FROM chain GROUP BY start_id, last, list_sort(huts)) b JOIN exits e ON e.hut_id = b.last AND e.start_id = b.start_id WHERE e.h <= 8",
    "start_record",
    "hut_edge",
    more=SEARCH_SQL.replace("{most}", "3").replace("start_type = 1", "start_type = 2"),
)
ORACLES["connectivity"] = with_views(
    "SELECT k.variant, r.n AS rows, COUNT(*) AS connected, (SELECT COUNT(*) FROM hub WHERE hub_type = 0) - COUNT(*) AS isolated, COUNT(DISTINCT k.low) AS components, COUNT(*) - MAX(k.size) AS outside_largest FROM (SELECT variant, u, low, COUNT(*) OVER (PARTITION BY variant, low) AS size FROM (SELECT variant, u, MIN(label) AS low FROM walk GROUP BY 1, 2) l) k JOIN (SELECT variant, COUNT(*) AS n FROM links GROUP BY 1) r ON r.variant = k.variant GROUP BY k.variant, r.n",
    "graded_edge",
    "hub",
    more=f"RECURSIVE links AS (SELECT v.variant, from_id, to_id FROM graded_edge CROSS JOIN {VARIANT_SQL} WHERE {MASK_SQL}), twoway AS (SELECT variant, from_id AS u, to_id AS v FROM links UNION SELECT variant, to_id, from_id FROM links), walk AS (SELECT variant, u, u AS label FROM twoway UNION SELECT w.variant, b.u, w.label FROM walk w JOIN twoway b ON b.v = w.u AND b.variant = w.variant)",
)
ORACLES["nearest_starts"] = with_views(
    "SELECT hut_id, start_type, distance_m, access, edge_id FROM (SELECT r.*, MAX(k) FILTER (WHERE k <= 3) OVER w AS n, MIN(start_type) FILTER (WHERE k <= 3) OVER w = MAX(start_type) FILTER (WHERE k <= 3) OVER w AS alike, MIN(k) FILTER (WHERE k > 3 AND start_type <> first_type) OVER w AS other FROM (SELECT *, FIRST(start_type) OVER (PARTITION BY hut_id ORDER BY distance_m, edge_id, start_type, access) AS first_type, ROW_NUMBER() OVER (PARTITION BY hut_id ORDER BY distance_m, edge_id, variant) AS k FROM start_record WHERE COALESCE(access, '') NOT IN ('private', 'no')) r WINDOW w AS (PARTITION BY hut_id)) x WHERE CASE WHEN n = 3 AND alike AND other IS NOT NULL THEN k < 3 OR k = other ELSE k <= 3 END",
    "start_record",
)
ORACLES["map_clusters"] = with_views(
    "SELECT z AS zoom, CAST(FLOOR((lon + 180) / 360 * world / 60) AS BIGINT) AS x, CAST(FLOOR((0.5 - LN((1 + s) / (1 - s)) / (4 * PI())) * world / 60) AS BIGINT) AS y, COUNT(*) AS n, ROUND(AVG(lon), 6) AS lon, ROUND(AVG(lat), 6) AS lat FROM (SELECT lon, lat, SIN(RADIANS(lat)) AS s, z, 256 * POW(2.0, z) AS world FROM hub CROSS JOIN (VALUES (6), (10)) v(z)) h GROUP BY 1, 2, 3",
    "hub",
)
POINT_SQL = "CAST(ROUND_EVEN({0} / 1e-7, 0) AS BIGINT)"
_KEY = lambda a, b: "LPAD(CAST(" + POINT_SQL.format(a) + " AS VARCHAR), 12, '0') || '/' || LPAD(CAST(" + POINT_SQL.format(b) + " AS VARCHAR), 12, '0')"
STEP_SQL = f"steps AS (SELECT *, LEAST(p0, q0) AS p, GREATEST(p0, q0) AS q FROM (SELECT rec, {_KEY('lon', 'lat')} AS p0, {_KEY('lon2', 'lat2')} AS q0, lon, lat, lon2, lat2 FROM (SELECT *, LEAD(lon) OVER w AS lon2, LEAD(lat) OVER w AS lat2 FROM vertex WINDOW w AS (PARTITION BY rec ORDER BY pos)) v WHERE lon2 IS NOT NULL) k)"
METRE_SQL = f"(2 * 6371000.0 * ASIN(SQRT(POW(SIN((RADIANS(lat2) - RADIANS(lat)) / 2), 2) + COS(RADIANS(lat)) * COS(RADIANS(lat2)) * POW(SIN(RADIANS(lon2 - lon) / 2), 2))))"
ORACLES["segment_grades"] = with_views(
    f"SELECT rec, ROUND(SUM(m), 3) AS total_m, ROUND(SUM(CASE WHEN tier = 0 THEN m ELSE 0 END), 3) AS explicit_m, ROUND(SUM(CASE WHEN tier = 1 THEN m ELSE 0 END), 3) AS inferred_m, ROUND(SUM(CASE WHEN tier = 2 THEN m ELSE 0 END), 3) AS ungraded_m, ROUND(SUM(CASE WHEN excluded THEN m ELSE 0 END), 3) AS excluded_m, ROUND(SUM(CASE WHEN tier IS NULL THEN m ELSE 0 END), 3) AS unmatched_m, COALESCE(MAX(CASE WHEN tier < 2 THEN sac_rank END), -1) AS max_rank FROM (SELECT s.rec, {METRE_SQL} AS m, g.tier, g.excluded, g.sac_rank FROM steps s LEFT JOIN (SELECT p, q, tier, excluded, sac_rank FROM (SELECT p, q, CAST(rec % 3 AS INT) AS tier, rec % 7 = 0 AS excluded, CAST(rec % 5 - 1 AS INT) AS sac_rank, ROW_NUMBER() OVER (PARTITION BY p, q ORDER BY rec % 3 DESC, rec % 7 = 0 DESC, rec % 5 DESC) AS k FROM steps WHERE rec % 2 = 0) o WHERE k = 1) g ON g.p = s.p AND g.q = s.q) j GROUP BY rec",
    "vertex",
    more=STEP_SQL,
)
REACH_SQL = "CASE WHEN start_type = 2 THEN EXISTS (SELECT 1 FROM app p JOIN ext x ON p.start_id = x.start_id AND p.start_type = x.start_type WHERE p.hut_id = first AND x.hut_id = last AND p.start_type = s.start_type) ELSE EXISTS (SELECT 1 FROM app p WHERE p.hut_id = first AND p.start_type = s.start_type) AND EXISTS (SELECT 1 FROM ext x WHERE x.hut_id = last AND x.start_type = s.start_type) END"
ORACLES["trim_checks"] = with_views(
    f"SELECT trip_id, pos, reason IS NULL AS ok, reason FROM (SELECT trip_id, pos, CASE WHEN len(huts) <= 1 THEN 'last_hut' WHEN pos > 0 AND pos + 1 < len(huts) THEN CASE WHEN NOT EXISTS (SELECT 1 FROM adj a WHERE a.f = huts[pos] AND a.t = huts[pos + 2]) THEN 'no_link' END WHEN NOT ({REACH_SQL}) THEN 'no_ends' END AS reason FROM (SELECT *, CASE WHEN pos = 0 THEN huts[2] ELSE huts[1] END AS first, CASE WHEN pos + 1 = len(huts) THEN huts[len(huts) - 1] ELSE huts[len(huts)] END AS last FROM stops) s) r",
    "start_record",
    "hut_edge",
    more=POINTS_SQL,
)
BEST_SQL = f"b AS (SELECT hut_id, start_id, start_type, edge_id, h FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hut_id, start_id ORDER BY variant <> 0, h, edge_id) AS k FROM (SELECT *, {din()} AS h FROM start_record) r) o WHERE k = 1), x AS (SELECT hut_id, start_id, start_type, edge_id, h FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY hut_id, start_id ORDER BY h, edge_id) AS k FROM (SELECT *, {din('distance_m', 'descent_m', 'ascent_m')} AS h FROM start_record WHERE variant = 0) r) o WHERE k = 1), f AS (SELECT a, b, edge_id, reversed, h FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY h, edge_id * 2 + CAST(reversed AS INT)) AS k FROM (SELECT from_id AS a, to_id AS b, edge_id, FALSE AS reversed, {din()} AS h FROM hut_edge UNION ALL SELECT to_id, from_id, edge_id, TRUE, {din('distance_m', 'descent_m', 'ascent_m')} FROM hut_edge) r) o WHERE k = 1)"
ORACLES["trip_leg_table"] = with_views(
    "SELECT trip_id, CAST(0 AS INT) AS leg, 'start' AS kind, b.edge_id, CASE WHEN b.edge_id IS NOT NULL THEN FALSE END AS reversed, ROUND(b.h, 6) AS duration_h FROM trips t LEFT JOIN b ON b.hut_id = t.huts[1] AND b.start_id = t.start_id AND b.start_type = t.start_type UNION ALL SELECT trip_id, CAST(len(huts) AS INT), 'exit', x.edge_id, CASE WHEN x.edge_id IS NOT NULL THEN TRUE END, ROUND(x.h, 6) FROM trips t LEFT JOIN x ON x.hut_id = t.huts[len(t.huts)] AND x.start_id = t.exit_id AND x.start_type = t.start_type UNION ALL SELECT trip_id, CAST(i AS INT), 'hut', f.edge_id, f.reversed, ROUND(f.h, 6) FROM (SELECT trip_id, huts, UNNEST(range(1, len(huts))) AS i FROM trips) s LEFT JOIN f ON f.a = s.huts[i] AND f.b = s.huts[i + 1]",
    "start_record",
    "hut_edge",
    more=LEGS_SQL + ", " + BEST_SQL,
)
