"""Plans and results that must hold when the tables outgrow a machine."""

import math
import random

from pyspark.sql import functions as F

from routelake.functions import geo
from routelake.operators import routing, spatial, trip

EDGE = "cell_id int, variant int, edge_id long, u long, v long, length_m double, time_s double, ascent_m double, descent_m double, sac_rank int, via_ferrata boolean"


def test_hubs_dealt_over_lots_are_not_broadcast(spark):
    rng = random.Random(3)
    edges = [(0, v, 10 * i + v, *rng.sample(range(40), 2), 100.0 * rng.randint(1, 9), float(rng.randint(50, 900)), 5.0, 2.0, 1, False) for i in range(50) for v in (0, 2)]
    one = spark.createDataFrame(edges, EDGE)
    hubs = spark.createDataFrame([(0, n, n % 10 != 9) for n in range(60)], "cell_id int, node long, is_hut boolean")
    lots = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("cell_id")
    dealt = hubs.select(lots, "node", "is_hut").withColumn("is_hut", F.col("is_hut") & (F.col("node") % 5 == F.col("cell_id")))
    paths = routing.hub_paths(one.select(lots, *one.columns[1:]), dealt, 1500.0)
    assert "Broadcast" not in paths._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r.variant, r.source, r.target, r.time_s, r.distance_m, tuple(r.edge_ids)) for r in df.collect())
    assert rows(paths) == rows(routing.hub_paths(one, hubs, 1500.0)) != []


def test_a_walk_ends_with_its_wanted_nodes():
    links = {n: [(n + d, 1.0, float(1 + (n * 7) % 5)) for d in (-1, 1)] for n in range(2000)}
    whole, _ = routing.shortest(links, 1000, 2)
    best, into = routing.shortest(links, 1000, 2, wanted=[1003, 998])
    assert len(best) < 50 and all(best[t] == whole[t] for t in (1003, 998))
    assert into[1003][0] == 1002


def test_trim_checks_build_no_network_tables(spark, sf, tmp_path):
    from routelake import fixtures
    from routelake.plans.queries import QUERIES

    link = tmp_path / "sf"
    link.symlink_to(sf)
    got = QUERIES["trim_checks"](spark, str(link))
    assert got.count() == got.select("trip_id", "pos").distinct().count() > 0
    assert not [k for k in fixtures._built if k[1] == str(link)]
    fixtures.register(spark, sf)


def test_trim_checks_against_plain_rules(spark):
    rng = random.Random(8)
    pairs = {(s, h): rng.random() < 0.3 for s in range(60) for h in rng.sample(range(12), 3)}
    links = {(rng.randrange(12), rng.randrange(12)) for _ in range(20)}
    trips = [(t, 1 + t % 3, t, sorted(rng.sample(range(12), rng.randint(1, 5)))) for t in range(300)]
    rows = [(s, 1 + s % 3, [h for (x, h) in pairs if x == s], [h for (x, h), back in pairs.items() if x == s and back]) for s in range(60)]

    def reason(kind, huts, pos):
        if len(huts) == 1:
            return "last_hut"
        if 0 < pos < len(huts) - 1:
            return None if (huts[pos - 1], huts[pos + 1]) in links else "no_link"
        rest = huts[:pos] + huts[pos + 1 :]
        a = {s for s in range(60) if 1 + s % 3 == kind and (s, rest[0]) in pairs}
        b = {s for s in range(60) if 1 + s % 3 == kind and pairs.get((s, rest[-1]))}
        return None if (a & b if kind == 2 else a and b) else "no_ends"

    t = spark.createDataFrame([(t, k, s, s, h) for t, k, s, h in trips], "trip_id long, start_type int, start_id long, exit_id long, huts array<long>")
    got = trip.trim_checks(t, spark.createDataFrame(sorted(links), "from_id long, to_id long"), spark.createDataFrame(rows, "start_id long, start_type int, huts array<long>, exits array<long>")).collect()
    want = {(t, pos): reason(k, h, pos) for t, k, _, h in trips for pos in range(len(h))}
    assert {(r.trip_id, r.pos): r.reason for r in got} == want and len(got) == len(want)
    assert all(r.ok == (r.reason is None) for r in got) and {"no_link", "no_ends", "last_hut", None} <= set(want.values())


def _places(spark, n, seed, names):
    rng = random.Random(seed)
    return [(i, 9.5 + 7.5 * rng.random(), 46.4 + 2.1 * rng.random()) for i in range(n)], lambda rows: spark.createDataFrame(rows, names)


def _metres(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    return 2 * 6371000.0 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))


def test_pairs_in_range_are_dealt_by_cell(spark):
    left, one = _places(spark, 150, 1, "id long, lon double, lat double")
    right, other = _places(spark, 200, 2, "other long, lon2 double, lat2 double")
    want = {(a[0], b[0]): _metres(a, b) for a in left for b in right}
    for radius in (30_000.0, 400_000.0):
        for way in ({}, {"copy": "right"}, {"copy": "right", "fine": 2}, {"fine": 3}):
            found = spatial.bucket_join(one(left), other(right), radius, **way)
            assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
            got = {(r.id, r.other): r.distance_m for r in found.collect()}
            assert got.keys() == {k for k, d in want.items() if d <= radius} and all(abs(d - want[k]) < 1e-6 for k, d in got.items())


def test_nearest_looks_near_by_first(spark, monkeypatch):
    left, one = _places(spark, 150, 3, "id long, lon double, lat double")
    right, other = _places(spark, 2000, 4, "other long, lon2 double, lat2 double")
    far = [(1000, 9.5, 44.4), (1001, 9.5, 44.0), (1002, 1.0, 44.0)]
    twice = [(5000 + i, *right[i][1:]) for i in range(2000)]
    made, whole = [], spatial.bucket_join
    monkeypatch.setattr(spatial, "bucket_join", lambda *a, **k: made.append((a[2], f := whole(*a, **k))) or f)
    got = {r.id: (r.other, r.distance_m) for r in spatial.nearest(one(left + far), other(right + twice), 260_000.0, ["id"], ["other"], copy="right").collect()}
    for p in left + far:
        d, k = min((_metres(p, b), b[0]) for b in right)
        assert (p[0] in got) == (d <= 260_000) and (p[0] not in got or (got[p[0]][0] == k and abs(got[p[0]][1] - d) < 1e-6))
    assert 1002 not in got and 1000 in got
    assert [r for r, _ in made] == sorted(r for r, _ in made) and made[-1][0] == 260_000.0
    assert sum(f.count() for _, f in made) < 20 * len(left) + 3 * 4000


def test_rounded(spark):
    values = [0.0, 0.0004, 0.00051, 12.3456, 19999.99949, 1234.5675]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(geo.rounded(F.col("x"), 3).alias("x")).collect()]
    assert got == [0.0, 0.0, 0.001, 12.346, 19999.999, math.floor(1234.5675 * 1000 + 0.5) / 1000]


def test_partners_are_looked_for_only_where_no_hut_is(spark, sf, duck, monkeypatch):
    from routelake.plans import network

    asked, whole = [], spatial.nearest
    monkeypatch.setattr(spatial, "nearest", lambda points, *a, **k: asked.append({r.start_id for r in points.collect()}) or whole(points, *a, **k))
    got = {r.start_id: (r.hub_type, r.hub_id) for r in network.nearest_hub_huts_first(spark, sf).collect()}
    want = {s: (t, h) for s, t, h in duck.execute(network.ORACLES["nearest_hub_huts_first"]).fetchall()}
    assert got == want and {0, 3} == {t for t, _ in want.values()}
    by_hut = {s for s, (t, _) in want.items() if t == 0}
    assert len(asked) == 2 and by_hut < asked[0] and asked[1] == asked[0] - by_hut
