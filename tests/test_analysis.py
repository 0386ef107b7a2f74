"""Analyses, map functions and the linking of the study on small tables."""

from pyspark.sql import functions as F

from routelake.operators import analysis, mapping, polyline, study


def test_attribution(spark):
    line = [(1, i, 11.0 + i * 0.001, 47.0) for i in range(4)]
    v = spark.createDataFrame(line, "rec int, pos int, lon double, lat double")
    segs = [(11.001, 47.0, 11.0, 47.0, 0, 2, False), (11.0, 47.0, 11.001, 47.0, 2, -1, True), (11.001, 47.0, 11.002, 47.0, 1, 1, False)]
    lookup = analysis.strictest_segments(spark.createDataFrame(segs, "lon1 double, lat1 double, lon2 double, lat2 double, tier int, sac_rank int, excluded boolean"))
    r = analysis.attributed(v, lookup).first()
    third = r.total_m / 3
    assert abs(r.ungraded_m - third) < 0.01 and abs(r.inferred_m - third) < 0.01 and abs(r.unmatched_m - third) < 0.01 and r.explicit_m == 0 and abs(r.excluded_m - third) < 0.01 and r.max_rank == 1
    s = analysis.attribution_summary(analysis.attributed(v, lookup)).first()
    assert abs(s.matched - 2 / 3) < 1e-6 and s.fully_graded == 0


def test_blockers_and_substitutions(spark):
    rows = spark.createDataFrame([(True, False), (False, True), (True, True), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in rows.select(analysis.blocker(F.col("a"), F.col("b"))).collect()] == ["ungraded", "difficulty", "combined", "disconnected"]
    base = spark.createDataFrame([(1, 2, [1, 5, 2]), (1, 3, [1, 3])], "source int, target int, nodes array<int>")
    other = spark.createDataFrame([(1, 2, [1, 6, 2]), (1, 3, [1, 3])], "source int, target int, nodes array<int>")
    assert tuple(analysis.substitutions(base, other).first()) == (2, 1)


def test_k_best(spark):
    rows = [(1, 2, float(i), None, i) for i in range(5)] + [(1, 1, 9.0, None, 9), (1, 1, 0.5, "private", 10), (2, 2, 1.0, None, 11)]
    got = analysis.k_best(spark.createDataFrame(rows, "hut_id int, start_type int, distance_m double, access string, edge_id int"), 3)
    assert sorted((r.hut_id, r.edge_id) for r in got.collect()) == [(1, 0), (1, 1), (1, 9), (2, 11)]


def test_pair_sample(spark):
    pairs = spark.range(100).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.col("id").cast("double").alias("distance_m"))
    got = analysis.pair_sample(pairs, 5, 4)
    assert got.count() == 20 and got.groupBy("stratum").count().where("count != 4").count() == 0 and sorted(got.collect()) == sorted(analysis.pair_sample(pairs.repartition(3), 5, 4).collect())


def test_anchors(spark):
    legs = [(1, 0, 1000.0, False, None, 11.0, 47.0, 11.4, 47.0), (1, 1, 1000.0, True, [(11.1, 47.0)], 11.4, 47.0, 11.0, 47.0)]
    rows = spark.createDataFrame(legs, "tour_id int, leg int, distance_m double, reversed boolean, anchors array<struct<lon: double, lat: double>>, from_lon double, from_lat double, to_lon double, to_lat double")
    got = [(round(r.lon, 3), r.heading, r.rank) for r in mapping.anchors(rows, (0.0, 0.0, 90.0, 90.0)).orderBy("rank").collect()]
    assert got == [(11.3, "east", 1), (11.2, "east", 2), (11.1, "west", 3), (11.1, "east", 4)]


def test_signposts(spark):
    spot = [(100.0, 100.0, True), (100.0, 200.0, True)]
    tours = [(1, 1, "a", 60.0, spot), (1, 2, "b", 60.0, spot), (1, 3, "c", 60.0, spot[:1]), (1, 4, "d", 60.0, spot[:1])]
    schema = "view int, rank int, key string, width double, spots array<struct<x: double, y: double, east: boolean>>"
    t = spark.createDataFrame(tours, schema)
    first = {r.key: (r.kind, r.x, r.y, r.side) for r in mapping.signposts(t, (300.0, 300.0)).collect()}
    assert first["a"] == ("board", 100.0, 100.0, "right") and first["b"] == ("board", 100.0, 200.0, "right") and first["c"][0] == "dot" and first["d"][0] == "dot"
    previous = spark.createDataFrame([(1, "b", "board", 100.0, 100.0, "right")], "view int, key string, kind string, x double, y double, side string")
    again = {r.key: (r.kind, r.y, r.side) for r in mapping.signposts(t, (300.0, 300.0), previous).collect()}
    assert again["b"] == ("board", 100.0, "right") and again["a"] == ("board", 200.0, "right")


def test_signpost_boxes(spark):
    """A board with its mast is 50 px high and its tail stands one pixel beyond the foot; a dot keeps 8 px from every foot."""
    schema = "view int, rank int, key string, width double, spots array<struct<x: double, y: double, east: boolean>>"
    place = lambda rows: {r.key: (r.kind, r.x, r.y, r.side) for r in mapping.signposts(spark.createDataFrame(rows, schema), (200.0, 200.0)).collect()}
    assert place([(1, 1, "a", 60.0, [(100.0, 50.0, True)])])["a"][0] == "board" and place([(1, 1, "a", 60.0, [(100.0, 49.0, True)])])["a"][0] == "dot"
    assert place([(1, 1, "a", 60.0, [(1.0, 90.0, True)])])["a"][3] == "right" and place([(1, 1, "a", 60.0, [(0.5, 90.0, True)])])["a"][0] == "dot"
    near = place([(1, 1, "a", 60.0, [(100.0, 90.0, True)]), (1, 2, "b", 150.0, [(100.0, 97.0, True), (100.0, 98.0, True)])])
    assert near["b"] == ("dot", 100.0, 98.0, "right")


def test_trip_profile(spark):
    legs = spark.createDataFrame([(1, 0, 1000.0, False, [1.0, 2.0, 3.0]), (1, 1, 500.0, True, [9.0, 5.0])], "trip_id int, leg int, distance_m double, reversed boolean, profile array<double>")
    got = [(round(r.km, 3), r.ele) for r in mapping.trip_elevation(legs).orderBy("leg", "i").collect()]
    assert got == [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0), (1.0, 5.0), (1.5, 9.0)]
    at = polyline.leg_at(legs, spark.createDataFrame([(1, 0.25), (1, 1.0), (1, 1.5)], "trip_id int, km double"))
    assert sorted((r.km, r.leg, r.fraction) for r in at.collect()) == [(0.25, 0, 0.25), (1.0, 1, 0.0), (1.5, 1, 1.0)]


def test_centroid(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    r = spark.createDataFrame([(ring,)], "r array<struct<lon: double, lat: double>>").select(mapping.centroid(F.col("r")).alias("c")).first()
    assert tuple(r.c) == (1.0, 1.0)


def test_trips_of_tours(spark):
    tours = spark.createDataFrame([("t", 5, [1, 2], 6), ("u", 5, [1], 99)], "tour_id string, start_id long, huts array<long>, exit_start_id long")
    starts = spark.createDataFrame([(5, 1), (6, 1)], "start_id long, start_type int")
    huts = spark.createDataFrame([(1, "Alm")], "hut_id long, name string")
    got = mapping.as_trips(tours, starts, huts, "2026-06-01", 2).collect()
    assert [(r.tour_id, r.name, r.exit_id) for r in got] == [("t", "Alm – ?", 6)]
    places = spark.createDataFrame([("start", 5, 1.0, 1.0), ("hut", 1, 2.0, 1.0), ("hut", 2, 3.0, 1.0), ("start", 6, 4.0, 1.0)], "kind string, id long, lon double, lat double")
    assert [[p.lon for p in r.points] for r in mapping.waypoints(tours, places).collect()] == [[1.0, 2.0, 3.0, 4.0]]


def test_linked_huts(spark):
    f = [(1, "{a}", "A", True, 900, 8, 11.0, 47.0), (1, "{b}", "B", False, 950, 8, 11.2, 47.0), (2, "{c}", "C", False, 800, 5, 13.0, 47.0), (3, "{d}", "D", True, 800, 3, 10.0, 47.0)]
    features = spark.createDataFrame(f, "ohrs_id int, guid string, name string, serviced boolean, elevation int, club int, lon double, lat double")
    info = spark.createDataFrame([(1, 40), (2, 10)], "ohrs_id int, capacity int")
    guids = spark.createDataFrame([("{A}",), ("{X}",)], "guid string")
    minutes = spark.createDataFrame([("{b}", 90), ("{a}", 120)], "guid string, minutes int")
    got = {r.ohrs_id: r for r in study.linked(features, info, guids, minutes, info.select("ohrs_id")).collect()}
    assert got[1].on_tour and got[1].error is None and got[1].approach_time_min == 90 and got[1].operator == "OEAV" and got[1].region == "central"
    assert got[2].error == "self_service" and got[3].error == "no_capacity" and [r.guid for r in study.unmatched_guids(guids, features).collect()] == ["{X}"]


def test_rank_share(spark):
    effects = spark.createDataFrame([("t", 1, -0.2), ("t", 2, 0.1), ("u", 3, 0.0), ("u", 4, -0.5), ("v", 5, 0.1)], "tour string, a long, effect double")
    chosen = spark.createDataFrame([("t", 1), ("u", 3), ("v", 5)], "tour string, a long")
    assert tuple(study.rank_share(effects, chosen).first()) == (2, 0.5, 0.5)
