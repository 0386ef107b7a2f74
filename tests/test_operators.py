"""Operators on small tables with results worked out by hand or by plain code."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from routelake.functions import geo, text, walking
from routelake.operators import availability, grading, graph, legs, polyline, quality, routing, spatial, stats, study
from routelake.schema import resolve_variant
from routelake.sources import io
from routelake.streaming import runs, trips


def test_grades(spark):
    ways = spark.createDataFrame(
        [(1, {"sac_scale": "alpine_hiking", "highway": "path"}), (2, {"highway": "steps"}), (3, {"highway": "path", "surface": "asphalt"}), (4, {"highway": "path"}), (5, {"highway": "track", "access": "no"}), (6, {"highway": "track", "access": "no", "foot": "yes"}), (7, {"sac_scale": "nonsense", "highway": "track", "ladder": "yes"})],
        "way_id int, tags map<string, string>",
    )
    ways = ways.select("way_id", *[F.col("tags")[k].alias(k) for k in ("sac_scale", "highway", "surface", "access", "foot", "trail_visibility", "informal", "ladder")])
    got = {r.way_id: (r.sac_rank, r.tier, r.constrained_ok) for r in grading.passable_graded(ways).collect()}
    assert got == {1: (4, "explicit", True), 2: (2, "inferred", True), 3: (1, "inferred", True), 4: (-1, "ungraded", False), 6: (1, "inferred", False), 7: (1, "inferred", False)}


def test_variants(spark):
    edges = spark.createDataFrame([(1, 2, False, False, True), (2, 3, False, False, True), (3, -1, False, False, False), (4, 2, True, False, False), (5, 4, False, False, True)], "edge_id int, sac_rank int, via_ferrata boolean, downgraded boolean, constrained_ok boolean")
    got = {}
    for r in grading.by_variant(edges).collect():
        got.setdefault(r.variant_name, set()).add(r.edge_id)
    assert got == {"FAST_ANY": {1, 2, 3, 4, 5}, "FAST_T2": {1}, "FAST_T3": {1, 2}, "FAST_T3_UNGRADED": {1, 2, 3}}
    names = ["FAST_ANY", "FAST_T2", "FAST_T3", "FAST_T3_UNGRADED"]
    assert [resolve_variant(c, u, names) for c, u in ((2, True), (3, False), (3, True), (5, False), (None, False))] == [1, 2, 3, 0, 0]
    assert resolve_variant(2, False, ["FAST_ANY"]) is None


def test_durations(spark):
    r = spark.range(1).select(walking.leg_hours(F.lit(8000.0), F.lit(300.0), F.lit(500.0)), walking.edge_seconds(F.lit(0.0), F.lit(5.0)), walking.edge_seconds(F.lit(100.0), F.lit(-5.0)), walking.edge_seconds(F.lit(30.0), F.lit(40.0), F.lit(True))).first()
    assert r[0] == 3.0 and r[1] == 0.0 and math.isclose(r[2], 100 / (4.013 / 3.6)) and r[3] == 250.0


def test_null_points_have_no_distance(spark):
    assert spark.range(1).select(geo.haversine_m(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0))).first()[0] is None


def test_polyline_resampling_and_smoothing(spark):
    line = [(1, i, 11.0 + i * 0.001, 47.0, 1000.0 + 10 * i * i) for i in range(6)] + [(2, 0, 11.0, 47.0, 5.0)] + [(3, i, 11.0, 47.0, 7.0 + i) for i in range(3)]
    v = spark.createDataFrame(line, "rec int, pos int, lon double, lat double, ele double")
    got = {}
    for r in polyline.resampled(v, 4).orderBy("rec", "i").collect():
        got.setdefault(r.rec, []).append(r.ele)
    xs = np.arange(6) * 1.0
    assert got[1] == [round(x, 1) for x in np.interp(np.linspace(0, 5, 4), xs, 1000 + 10 * xs**2)] and got[3] == [7.0] * 4 and 2 not in got
    seg = polyline.with_arc(v.where("rec = 1")).orderBy("pos").collect()
    at, ele = np.array([r.at_m for r in seg]), np.array([r.ele for r in seg])
    weight = np.clip(1 - np.abs(at[:, None] - at[None, :]) / 100, 0, None)
    want = (weight @ ele) / weight.sum(1)
    smooth = [r.ele for r in polyline.smoothed(v.where("rec = 1"), 200.0).orderBy("pos").collect()]
    assert np.allclose(smooth, want)


def test_merged_segments(spark):
    rows = spark.createDataFrame([(1, [(10.0, 1.0), (25.0, 2.0), (40.0, -1.0), (5.0, 3.0)])], "rec int, segs array<struct<len: double, dz: double>>")
    assert [tuple(x) for x in polyline.merged_segments(rows, 30.0).first().segs] == [(35.0, 3.0), (40.0, -1.0), (5.0, 3.0)]


def test_bucket_join_is_exact(spark):
    rng = random.Random(3)
    a = [(i, 10 + rng.random(), 47 + rng.random()) for i in range(60)]
    b = [(i, 10 + rng.random(), 47 + rng.random()) for i in range(60)]
    left, right = spark.createDataFrame(a, "id int, lon double, lat double"), spark.createDataFrame(b, "other int, lon2 double, lat2 double")
    got = {(r.id, r.other) for r in spatial.bucket_join(left, right, 9000.0).collect()}

    def metres(p, q):
        p1, p2 = math.radians(p[2]), math.radians(q[2])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert got == {(p[0], q[0]) for p in a for q in b if metres(p, q) <= 9000}


def test_snap(spark):
    hubs = spark.createDataFrame([(0, 1, 11.0, 47.0, 1000.0), (0, 2, 11.001, 47.0003, 1000.0), (0, 3, 12.0, 47.0, 1000.0), (0, 4, 11.0, 47.0, 1100.0)], "hub_type int, hub_id long, lon double, lat double, ele double")
    nodes = spark.createDataFrame([(7, 11.0, 47.00001, 1005.0)], "node_id long, lon2 double, lat2 double, ele2 double")
    segments = spark.createDataFrame([(5, 0, 11.0, 47.00001, 11.002, 47.00001, 1005.0, 1015.0)], "edge_id long, seg int, lon_a double, lat_a double, lon_b double, lat_b double, ele_a double, ele_b double")
    got = {r.hub_id: (r.kind, r.reason) for r in spatial.snap(hubs, nodes, segments).collect()}
    assert got == {1: ("node", None), 2: ("edge", None), 3: ("rejected", "gap_too_far"), 4: ("rejected", "vertical_offset")}


def test_stops_once(spark):
    rows = [
        (1, "A", True, 11.0, 47.0), (2, "A", False, 11.0001, 47.0), (3, "A", False, 11.0002, 47.0), (4, "A", True, 11.1, 47.0), (5, "A", True, 11.1004, 47.0), (6, "A", True, 11.1008, 47.0),
        (7, "A", True, 11.1012, 47.0), (8, "B", True, 11.0, 47.0), (9, None, True, 12.0, 47.0), (10, None, True, 12.0001, 47.0), (11, "C", False, 12.0, 47.0), (12, "C", False, 12.0, 47.0), (13, "A", True, 13.0, 47.0),
    ]
    stops = spark.createDataFrame(rows, "id int, name string, is_position boolean, lon double, lat double")
    plain = []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        near = lambda o: o[1] == r[1] and math.hypot((o[3] - r[3]) * math.cos(math.radians(47)), o[4] - r[4]) * 111_195 <= 40  # noqa: E731, B023
        if not (r[2] and any(map(near, plain))):
            plain.append(r)
    got = spatial.stops_once(stops)
    assert got.columns == stops.columns and sorted(r.id for r in got.collect()) == sorted(r[0] for r in plain) == [2, 3, 4, 6, 8, 9, 11, 12, 13]


def test_simplified(spark):
    line = [(i * 0.1, 0.0 if i != 5 else 1.0) for i in range(11)]
    rows = spark.createDataFrame([(1, line), (2, line[:2])], "id int, points array<struct<lon: double, lat: double>>")
    got = {r.id: [tuple(p) for p in r.points] for r in spatial.simplified(rows, 0.3).collect()}
    assert line[5] in got[1] and len(got[1]) < 11 and got[2] == line[:2]


def test_raster_and_mosaic(spark):
    raster = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row long, col long, value double")
    points = spark.createDataFrame([(1, 0.5, 1.25), (2, 5.0, 5.0)], "id int, lon double, lat double")
    got = {r.id: r.value for r in spatial.raster_samples(points, raster, 0.0, 0.0, 1.0).collect()}
    assert got == {1: 13.0, 2: None}
    tiles = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 7.0), (3, 0, 0, None)], "priority int, row int, col int, value double")
    assert spatial.mosaic(tiles).first().value == 7.0


def test_contraction(spark):
    chain = [(1, 1, 2, 10.0, 1), (2, 2, 3, 20.0, 3), (3, 3, 4, 5.0, -1), (4, 4, 5, 1.0, 0), (5, 4, 6, 1.0, 0), (6, 10, 11, 1.0, 0), (7, 11, 12, 1.0, 0), (8, 12, 10, 1.0, 0)]
    s = spark.createDataFrame([(*x, x[0] == 2, False, x[0] != 3) for x in chain], "seg_id long, u long, v long, length_m double, sac_rank int, via_ferrata boolean, downgraded boolean, constrained_ok boolean")
    got = {(r.u, r.v): (r.length_m, r.sac_rank, r.via_ferrata, r.constrained_ok, r.segs) for r in graph.contracted(s).collect()}
    assert got == {(1, 4): (35.0, 3, True, False, 3), (4, 5): (1.0, 0, False, True, 1), (4, 6): (1.0, 0, False, True, 1), (10, 10): (3.0, 0, False, True, 3)}


def test_routes(spark):
    rng = random.Random(5)
    edges = [(0, 0, i, rng.randrange(12), rng.randrange(12), 100.0 * rng.randint(1, 9), float(rng.randint(50, 900)), 5.0, 2.0, 1, False) for i in range(30)]
    e = spark.createDataFrame(edges, "cell_id int, variant int, edge_id long, u long, v long, length_m double, time_s double, ascent_m double, descent_m double, sac_rank int, via_ferrata boolean")
    hubs = spark.createDataFrame([(0, n, n < 3) for n in range(8)], "cell_id int, node long, is_hut boolean")
    got = {(r.source, r.target): (r.time_s, r.distance_m) for r in routing.hub_paths(e, hubs, 1500.0).collect()}

    def floyd(k):
        d = np.full((12, 12), np.inf)
        np.fill_diagonal(d, 0)
        for x in edges:
            d[x[3], x[4]] = d[x[4], x[3]] = min(d[x[3], x[4]], x[k]) if x[3] != x[4] else 0
        for m in range(12):
            d = np.minimum(d, d[:, [m]] + d[[m], :])
        return d

    far, fast = floyd(5), floyd(6)
    for (a, b), (t, d) in got.items():
        assert t == fast[a, b] and far[a, b] <= d <= 1500
    assert all(far[a, b] <= 1500 for a, b in got)
    relaxed = {(r.source, r.node): r.distance_m for r in routing.relaxed(e, spark.createDataFrame([(0,), (1,)], "node long"), 1500.0).collect()}
    assert relaxed == {(a, b): far[a, b] for a in (0, 1) for b in range(12) if far[a, b] <= 1500 and (a == b or any(b in (x[3], x[4]) for x in edges))}


def test_split_edges(spark):
    e = spark.createDataFrame([(1, 1, 2, 100.0, 60.0, 10.0, 4.0), (2, 2, 3, 50.0, 30.0, 0.0, 0.0)], "edge_id long, u long, v long, length_m double, time_s double, ascent_m double, descent_m double")
    s = spark.createDataFrame([(1, 99, 0.25)], "edge_id long, hub_node long, share double")
    got = {r.edge_id: (r.u, r.v, r.time_s, r.ascent_m) for r in graph.split_edges(e, s).collect()}
    assert got == {6: (2, 3, 30.0, 0.0), 4: (1, 99, 25.0, 0.0), 5: (99, 2, 75.0, 0.0)}
    assert {r.edge_id: r.time_s for r in graph.split_edges(e, s, "share").collect()} == {6: 30.0, 4: 15.0, 5: 45.0}


def test_approaches(spark):
    rows = [(1, 100, 1, 1, 0, 4000.0, 0.0, 0.0, None), (2, 101, 1, 1, 0, 4000.0, 0.0, 0.0, "yes"), (3, 102, 1, 1, 0, 20000.0, 0.0, 0.0, None), (4, 103, 2, 1, 1, 4000.0, 0.0, 0.0, None), (5, 100, 1, 2, 3, 4000.0, 0.0, 0.0, None)]
    s = spark.createDataFrame(rows, "edge_id long, start_id long, start_type int, hut_id long, variant int, distance_m double, ascent_m double, descent_m double, access string")
    m = legs.approach_matrix(s)
    assert sorted((r.edge_id, r.bucket, r.access_unknown) for r in m.collect()) == [(1, 0, True), (3, 1, True)]
    assert sorted(r.edge_id for r in legs.loop_closure(s, m).collect()) == [1, 3, 5]
    assert [r.edge_id for r in legs.exit_only(legs.loop_closure(s, m), m).collect()] == [5]


def test_nights(spark):
    rows = spark.createDataFrame([("SERVICED", [3, 4], 2), ("SERVICED", [1], 2), ("SERVICED", [0], 2), ("SERVICED", [], 2), ("RESERVATION_NOT_POSSIBLE", [9], 2), ("TECHNICAL_ERROR", [9], 2), (None, None, 2)], "s string, f array<int>, p int")
    assert [r[0] for r in rows.select(availability.night_kind(F.col("s"), F.col("f"), F.col("p"))).collect()] == ["free", "few", "full", "unknown", "full", "unknown", "unknown"]


def test_reports(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, w double")
    r = quality.report(rows.where("w > 3"), "c", "p", rows, baseline=2, cap=3, worst="w").first()
    assert (r.checked, r.flagged, r.truncated, len(r.rows)) == (10, 6, True, 3) and '"w":9.0' in r.rows[0]
    ring = io.ring_edges("x\nouter\n 0 0\n 4 0\n 4 4\n 0 4\nEND\n!hole\n 1 1\n 2 1\n 2 2\n 1 2\nEND\nEND\n")
    edges = spark.createDataFrame(ring, "x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 5.0, 1.0)], "pid int, lon double, lat double")
    assert [r.pid for r in quality.inside(points, edges).collect()] == [1]
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "name string, n int"), spark.createDataFrame([("x", 1), ("z", 3)], "name string, n int")
    assert sorted((r.name, r.stated, r.found) for r in quality.counts_disagree(a, b).collect()) == [("y", 2, None), ("z", None, 3)]


def test_study_series(spark):
    days = spark.createDataFrame([(1, "2024-06-01", 1.0), (1, "2024-06-02", None), (1, "2024-06-04", 0.0)], "ohrs_id int, d string, v double").withColumn("d", F.to_date("d"))
    assert [r.shifted for r in study.shifted(days, 2).orderBy("d").collect()] == [None, None, None]
    assert [r.shifted for r in study.shifted(days, 3).orderBy("d").collect()] == [None, None, 1.0]
    moved = study.shuffled(days, 1)
    assert moved.where("v IS NOT NULL").count() == 2 and moved.count() == 3


def test_candidates(spark):
    tours = spark.createDataFrame([("small", [1, 2, 3]), ("few", [1, 9]), ("tie", [4, 5, 2])], "tour string, huts array<long>")
    table = spark.createDataFrame([(1, 10, 0.1), (2, 40, 0.2), (3, 50, 0.0), (4, 20, 0.1), (5, 20, 0.4)], "ohrs_id long, capacity int, sold_out_share double")
    got = {r.tour: (r.bottleneck, r.ratio, r.qualifies, r.n_eligible) for r in study.candidates(tours, table).collect()}
    assert got == {"small": (1, 0.25, True, 3), "few": (None, None, False, 1), "tie": (5, 1.0, False, 3)}


def test_regressions(spark):
    rng = np.random.default_rng(0)
    x = np.stack([np.ones(200), rng.normal(size=200)], 1)
    y = x @ [1.0, 2.0] + rng.normal(size=200)
    beta, se = stats.ols_hc3(x, y)
    assert np.allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0]) and 0.04 < se[1] < 0.12
    trials = np.full(200, 50.0)
    hits = rng.binomial(50, 1 / (1 + np.exp(-(0.3 + 0.5 * x[:, 1])))).astype(float)
    logit, _ = stats.logit_hc1(x, hits, trials)
    assert np.allclose(logit, [0.3, 0.5], atol=0.1)
    huts, days = 8, 12
    panel = pd.DataFrame([(h, d, h % 4, int(h < 4)) for h in range(huts) for d in range(days)], columns=["hut", "d", "b", "tour"])
    panel["treat"] = rng.integers(0, 2, days)[panel["d"]].astype(float)
    panel["x"] = panel["tour"] * panel["treat"]
    panel["y"] = 0.7 * panel["x"] + panel["hut"] * 0.1 + panel["d"] * 0.05 + rng.normal(size=len(panel)) * 0.01
    table = spark.createDataFrame(panel.astype({"hut": "int64", "b": "int64"})).withColumn("spec", F.lit("s"))
    got = stats.did_fit(table, "spec").first()
    dummies = np.concatenate([panel[["x", "treat"]].to_numpy(float), pd.get_dummies(panel["hut"]).to_numpy(float), pd.get_dummies(panel["d"]).to_numpy(float)], 1)
    plain = np.linalg.lstsq(dummies, panel["y"], rcond=None)[0]
    assert math.isclose(got.coef, plain[0], abs_tol=1e-9) and got.n == len(panel) and got.clusters == 4
    # Errors by cluster, from the rows themselves.
    inside = panel["x"] - dummies[:, 1:] @ np.linalg.lstsq(dummies[:, 1:], panel["x"], rcond=None)[0]
    sums = (inside * (panel["y"] - dummies @ plain)).groupby(panel["b"]).sum()
    assert math.isclose(got.se, np.sqrt((sums**2).sum()) / (inside @ inside) * np.sqrt(4 / 3 * (len(panel) - 1) / (len(panel) - 1)), rel_tol=1e-6)
    assert stats.did_fit(table.withColumn("x", F.lit(0.0)), "spec").first().skipped == stats.NO_TREATED
    assert stats.did_fit(table.where("b = 1"), "spec").first().skipped == stats.FEW_CLUSTERS
    left = panel["y"] - dummies @ plain
    mde = stats.did_powers(table, "spec").first().mde
    assert math.isclose(mde, stats.detection_factor() * np.sqrt(left @ left / (len(panel) - 2) / (inside @ inside)), rel_tol=1e-6)
    boot = stats.did_bootstrap(table, draws=16).toPandas()
    assert len(boot) == 16 and abs(boot["coef"].mean() - 0.7) < 0.05
    sides = spark.createDataFrame([(i, float(i % 7) + (i % 2), i % 2 == 0) for i in range(200)] + [(200, None, True)], "k long, v double, s boolean")
    got = stats.bootstrap(sides, "k", "v", "s", draws=400).first()
    means = sides.groupBy("s").agg(F.avg("v").alias("m")).collect()
    diff = {r.s: r.m for r in means}
    assert math.isclose(got.estimate, diff[True] - diff[False]) and got.lo < got.estimate < got.hi and got.hi - got.lo < 2
    one = stats.bootstrap(sides, "k", "v", draws=50).first()
    assert one.lo < one.estimate < one.hi
    est = spark.createDataFrame([((0.2, 0.1, 0.3), (0.4, 0.25, 0.6)), ((0.2, 0.1, 0.3), (-0.4, -0.6, 0.2)), ((0.2, 0.1, 0.3), (0.4, 0.35, 0.6))], "a struct<coef: double, lo: double, hi: double>, b struct<coef: double, lo: double, hi: double>")
    assert [r[0] for r in est.select(stats.replicated(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    ranked = stats.nearest_rank(sides, ["s"], "v", 0.5).collect()
    by = {s: sorted(r.v for r in sides.where("v IS NOT NULL").collect() if r.s == s) for s in (True, False)}
    assert {r.s: r.v for r in ranked} == {s: v[len(v) // 2] for s, v in by.items()}


def test_links_and_columns(spark):
    one = spark.createDataFrame([(1, 5, 6, [7, 8], "2026-06-01", 2), (1, 5, 6, [7], "June", 2), (1, 5, 6, [], None, 2)], "start_type int, start_id long, exit_id long, huts array<long>, date string, party int")
    back = one.select(io.from_trip_link(io.trip_link(F.struct(*one.columns))).alias("t")).collect()
    assert back[0].t.huts == [7, 8] and back[1].t is None and back[2].t is None
    bad = spark.createDataFrame([("#trip=%%%",), ("x",), ("#trip=",)], "l string")
    assert all(r.t is None for r in bad.select(io.from_trip_link(F.col("l")).alias("t")).collect())
    rows = pd.DataFrame({"a": [1, 2, 300], "b": [0.5, 1.5, 2.5]})
    data, manifest = io.pack_columns(rows, {"a": "u2", "b": "f4"})
    assert io.read_columns(data, manifest).astype(float).equals(rows.astype(float)) and list(io.size_report(data, manifest)["bytes"]) == [6, 12]


def test_text(spark):
    r = spark.range(1).select(text.signpost_time(F.lit(2.3)), text.signpost_time(F.lit(0.5)), text.kilometres(F.lit(12345.0)), text.metres(F.lit(1234)), text.number_of_feature(F.lit("n123")), text.guids(F.lit("x {ab} {cd}")), text.normalised(F.lit("Groß-Venediger 1!"))).first()
    assert tuple(r) == ("2¼ Std", "½ Std", "12.3 km", "1.234 m", 123, ["{AB}", "{CD}"], "großvenediger1")


def test_geojson(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"n12","geometry":{"type":"Point","coordinates":[11.5,47.5]},"properties":{"name":"A"}},{"type":"Feature","geometry":null,"properties":{}}]}')
    assert [(r.osm_id, r.name, r.lon) for r in io.read_points(spark, str(tmp_path / "p.json")).collect()] == [(12, "A", 11.5)]


def trip_of(key, **more):
    return {"id": key, "name": key, "startDate": None, "partySize": 1, "start": {"startId": 1, "sourceType": 1}, "huts": ["{A}"], "exit": {"startId": 1, "sourceType": 1}, **more}


def after(*actions, state=None):
    state = state or trips.start()
    for action, body in actions:
        state = trips.reduced(state, action, body)
    return state


def test_saved_trips():
    ids = lambda s: [t["id"] for t in s["trips"]]
    three = after(*[("create", {"trip": trip_of(k)}) for k in "abc"])
    assert ids(three) == ["a", "b", "c"] and three["active"] == "c"
    new = after(("update", {"trip": trip_of("a", name="neu"), "now": "2026-07-01"}), state=three)
    assert (new["trips"][0]["name"], new["trips"][0]["updatedAt"]) == ("neu", "2026-07-01") and new["trips"][1] == trip_of("b")
    assert after(("closeActive", None), state=three)["active"] is None
    gone = after(("setActive", {"id": "b"}), ("delete", {"id": "b"}), state=three)
    assert ids(gone) == ["a", "c"] and gone["active"] is None
    back = after(("undoDelete", None), state=gone)
    assert ids(back) == ["a", "b", "c"] and back["deleted"] is None
    assert after(("delete", {"id": "x"}), ("undoDelete", None), state=three) == three
    assert ids(after(("import", {"trips": [trip_of("a"), trip_of("z")]}), state=three)) == ["a", "b", "c", "a-copy", "z"]


def test_drafts():
    opened = after(("openDraft", {"trip": trip_of("a")}))
    assert opened["draft"] == opened["opened"] == trip_of("a") and opened["on_draft"] and opened["active"] is None and not trips.dirty(opened)
    edited = after(("updateDraft", {"trip": trip_of("a", partySize=3)}), state=opened)
    assert edited["draft"]["partySize"] == 3 and edited["opened"] == trip_of("a") and trips.dirty(edited)
    assert not trips.dirty(after(("updateDraft", {"trip": trip_of("a", name="b", booked=True)}), state=opened))
    for k, v in (("huts", ["{B}"]), ("startDate", "2026-06-01"), ("start", {"startId": 2, "sourceType": 1}), ("exit", {"startId": 1, "sourceType": 2})):
        assert trips.dirty(after(("updateDraft", {"trip": trip_of("a", **{k: v})}), state=opened))
    saved = after(("saveDraft", {"name": "n"}), state=edited)
    assert saved["draft"] is saved["opened"] is None and saved["active"] == "a" and not saved["on_draft"] and saved["trips"][0]["name"] == "n"
    assert after(("saveDraft", None), ("updateDraft", {"trip": trip_of("q")}), ("reopenDraft", None)) == trips.start()
    closed = after(("closeActive", None), state=opened)
    assert closed["draft"] and not closed["on_draft"] and after(("reopenDraft", None), state=closed)["on_draft"]


def test_unsaving():
    two = after(("create", {"trip": trip_of("a")}), ("create", {"trip": trip_of("b")}))
    un = after(("unsave", {"id": "a", "name": "draft"}), state=two)
    assert [t["id"] for t in un["trips"]] == ["b"] and un["draft"]["name"] == "draft" and un["on_draft"] and un["unsaved"] == {"id": "a", "place": 0, "name": "a"}
    back = after(("undoUnsave", None), state=un)
    assert [t["id"] for t in back["trips"]] == ["a", "b"] and back["trips"][0]["name"] == "a" and back["draft"] is None and back["active"] == "a" and not back["on_draft"]
    other = after(("openDraft", {"trip": trip_of("c")}), state=un)
    assert after(("undoUnsave", None), state=other) == other and other["unsaved"] is None
    assert after(("dismissUnsave", None), state=un)["unsaved"] is None and after(("unsave", {"id": "x"}), state=two) == two


def test_trip_fold_as_batch_and_stream(spark, tmp_path):
    import json

    one = lambda k, **more: json.dumps({"trip": trip_of(k, **more), "trips": [trip_of(k)], "id": k})
    rows = [(1, 1, "openDraft", one("a")), (1, 2, "saveDraft", None), (1, 3, "unsave", one("a")), (1, 4, "updateDraft", one("a", partySize=2)), (2, 1, "import", one("a")), (2, 2, "import", one("a")), (2, 3, "delete", one("a")), (2, 4, "undoDelete", None), (2, 5, "delete", one("a-copy"))]
    events = spark.createDataFrame(rows, "user_id long, ord long, action string, body string")
    want = {r.user_id: tuple(r)[1:] for r in trips.folded(events).collect()}
    assert {u: (r[0], r[4], r[5], r[6]) for u, r in want.items()} == {1: ("", True, False, True), 2: ("a", False, True, False)}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = trips.streamed(stream).writeStream.outputMode("update").format("memory").queryName("trips_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.user_id: tuple(r)[1:] for r in spark.table("trips_out").collect()} == want


def test_stale_tasks(spark):
    tasks = spark.createDataFrame([("a", "1"), ("b", "2")], "task string, fingerprint string")
    done = spark.createDataFrame([("a", "1"), ("b", "0")], "task string, fingerprint string")
    assert [r.task for r in runs.stale(tasks, done).collect()] == ["b"]
    assert runs.fingerprint({"x": "1"}, {"k": 2}) == runs.fingerprint({"x": "1"}, {"k": 2}) != runs.fingerprint({"x": "1"}, {"k": 3})
