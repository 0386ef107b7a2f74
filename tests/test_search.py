"""The layered search against a plain enumerator that prunes by layers, overlap included."""

import random

import pytest
from pyspark.sql import functions as F

from routelake.operators import legs, search


def hours(d, a, b):
    level, steep = d / 4000, a / 300 + b / 500
    return max(level, steep) + min(level, steep) / 2


def graph(seed, huts=6, starts=3):
    rng = random.Random(seed)
    edges = [(u * 100 + v, u, v, 1000.0 * rng.randint(3, 14), 100.0 * rng.randint(0, 9), 100.0 * rng.randint(0, 9)) for u in range(huts) for v in range(u + 1, huts) if rng.random() < 0.7]
    links = [(s * 1000 + h, s, 1 + s % 2, h, 0, 1000.0 * rng.randint(2, 12), 100.0 * rng.randint(0, 8), 100.0 * rng.randint(0, 4)) for s in range(starts) for h in range(huts) if rng.random() < 0.6]
    ids = {e[0]: [rng.randint(0, 40) for _ in range(4)] for e in edges} | {x[0]: [100 + rng.randint(0, 20) for _ in range(3)] + [rng.randint(0, 40)] for x in links}
    return edges, links, ids


def run_of(a, b):
    out = set()
    for x, y in zip(a, b):
        if x != y:
            break
        out.add(x)
    return out


def enumerate_tours(edges, links, ids, mode, source, legs_max, max_h):
    """Layers of dictionaries: hut, then (start, visited), in insertion order, shorter totals replacing longer ones."""
    adjacent = {}
    for e, u, v, d, a, b in edges:
        adjacent.setdefault(u, []).append((v, e, False, hours(d, a, b)))
        adjacent.setdefault(v, []).append((u, e, True, hours(d, b, a)))
    layer, out = {}, []
    for h in sorted({x[3] for x in links}):
        for e, s, t, hut, _, d, a, b in sorted(links):
            if hut != h or (source and t != source) or hours(d, a, b) > max_h:
                continue
            state = (hours(d, a, b), [h], s, set(ids[e]), ids[e][::-1][:8], ids[e][:8])
            layer.setdefault(h, {}).setdefault((s, frozenset([h])), state)

    def finish():
        for h, states in layer.items():
            for total, path, s, used, arrived, home in states.values():
                for e, x, t, hut, _, d, a, b in links:
                    if hut != h or (source and t != source) or (mode == "car" and x != s) or hours(d, b, a) > max_h:
                        continue
                    exempt = run_of(arrived, ids[e][::-1][:8]) | (run_of(home, ids[e][:8]) if x == s else set())
                    if (set(ids[e]) - exempt) & used:
                        continue
                    out.append((s, x, tuple(path), round(total + hours(d, b, a), 6)))

    finish()
    for _ in range(1, legs_max - 1):
        grown = {}
        for h, states in layer.items():
            for total, path, s, used, arrived, home in states.values():
                for to, e, back, t in adjacent.get(h, []):
                    if to in path or t > max_h:
                        continue
                    departing = ids[e][::-1][:8] if back else ids[e][:8]
                    if (set(ids[e]) - run_of(arrived, departing)) & used:
                        continue
                    key, new = (s, frozenset([*path, to])), (total + t, [*path, to], s, used | set(ids[e]), ids[e][:8] if back else ids[e][::-1][:8], home)
                    known = grown.setdefault(to, {}).get(key)
                    if known is None or new[0] < known[0]:
                        grown[to][key] = new
        layer = grown
        finish()
    return sorted(out)


@pytest.mark.parametrize("seed,mode", [(1, "any"), (2, "any"), (3, "car"), (4, "transit")])
def test_against_enumerator(spark, seed, mode):
    edges, links, ids = graph(seed)
    e = spark.createDataFrame(edges, "edge_id long, from_id long, to_id long, distance_m double, ascent_m double, descent_m double").withColumns({"max_ele_m": F.lit(None).cast("double"), "via_ferrata": F.lit(False)})
    s = spark.createDataFrame(links, "edge_id long, start_id long, start_type int, hut_id long, variant int, distance_m double, ascent_m double, descent_m double")
    all_ids = legs.id_runs(spark.createDataFrame([(k, v) for k, v in ids.items()], "edge_id long, path_ids array<int>"))
    q = search.Query(mode=mode, legs_max=5, max_leg_h=6.0, with_ids=True)
    tours, kills = search.search(q, s.withColumn("duration_h", legs.hours()), s, legs.adjacency(e), all_ids, all_ids)
    got = sorted((r.start_id, r.exit_start_id, tuple(r.huts), round(r.total_h, 6)) for r in tours.collect())
    source = {"car": 2, "transit": 1}.get(mode)
    assert got == enumerate_tours(edges, links, ids, mode, source, 5, 6.0)
    counters = {r.reason: r.n for r in kills.collect()}
    assert set(counters) == set(search.REASONS) and {k for k, n in counters.items() if n} <= {"max_leg_time", "revisit", "track_overlap"}


def test_beds_and_allowed(spark):
    edges, links, _ = graph(5)
    e = spark.createDataFrame(edges, "edge_id long, from_id long, to_id long, distance_m double, ascent_m double, descent_m double").withColumns({"max_ele_m": F.lit(None).cast("double"), "via_ferrata": F.lit(False)})
    s = spark.createDataFrame(links, "edge_id long, start_id long, start_type int, hut_id long, variant int, distance_m double, ascent_m double, descent_m double").withColumn("duration_h", legs.hours())
    allowed = spark.createDataFrame([(h,) for h in range(5)], "hut_id long")
    beds = spark.createDataFrame([(0, 1, False), (1, 2, False), (2, 1, True)], "hut_id long, night int, free boolean")
    tours, _ = search.search(search.Query(mode="any", legs_max=4, max_leg_h=9.0, allowed=allowed, beds=beds), s, s, legs.adjacency(e))
    paths = {tuple(r.huts) for r in tours.collect()}
    assert paths and all(5 not in p and p[0] != 0 and (len(p) < 2 or p[1] != 1) for p in paths)


def test_runs_and_overlap(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([], [1]), ([5], [6]), ([1, 2], [1, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(search.common_run(F.col("a"), F.col("b"))).collect()] == [[1, 2], [], [], [1, 2]]


def test_similar_and_reverse(spark):
    rows = [(1, 1, [1, 2, 3], 5.0, [0]), (1, 2, [3, 2, 1], 4.0, [1]), (1, 3, [1, 2, 9], 6.0, [2]), (2, 4, [7, 8], 7.0, [3])]
    tours = spark.createDataFrame(rows, "start_id long, tour_id long, huts array<long>, total_h double, place array<long>")
    once = search.without_reverse_pairs(tours)
    assert sorted(r.tour_id for r in once.collect()) == [2, 3, 4]
    kept = search.without_similar(once.drop("seen"), "per_start")
    assert sorted(r.tour_id for r in kept.collect()) == [2, 4]
    assert sorted(r.tour_id for r in search.without_similar(tours, "global").collect()) == [2, 4]
    assert search.best_start(tours).first()[0] == 1


def test_order_of_equal_tours(spark):
    rows = [(1, [1], 5.0, [0]), (2, [2], 5.0, [1]), (3, [3], 4.0, [2])]
    tours = spark.createDataFrame(rows, "tour_id long, huts array<long>, total_h double, place array<long>")
    up = [r.tour_id for r in search.sorted_tours(tours, "duration").collect()]
    assert up == [3, 1, 2] and [r.tour_id for r in search.sorted_tours(tours, "duration", True).collect()] == up[::-1]
