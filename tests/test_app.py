"""Chains walked in order, lookups, files of days, and requests that replace each other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from routelake.operators import app, graph
from routelake.sources import io
from routelake.streaming import runs


def test_ordered_chains(spark):
    """Random trees with long branches, a ring and a loop: each chain is a path from tip to tip, and its climbs follow the walk."""
    rng, edges, node = random.Random(3), [], 100
    for tip in (1, 2, 3, 4):
        at = 0
        for _ in range(rng.randint(1, 6)):
            node += 1
            edges.append((at, node) if rng.random() < 0.5 else (node, at))
            at = node
        edges.append((tip, at) if rng.random() < 0.5 else (at, tip))
    edges += [(50, 51), (52, 51), (50, 52), (1, 1)]
    rows = [(i, u, v, 10.0 + i, float(i % 4), float(i % 3)) for i, (u, v) in enumerate(edges)]
    got = graph.ordered_chains(spark.createDataFrame(rows, "seg_id long, u long, v long, length_m double, ascent_m double, descent_m double")).collect()
    by_id, seen = {r[0]: r for r in rows}, []
    for c in got:
        walk = [c.u, *c.interior, c.v]
        assert len(walk) == len(c.seg_ids) + 1
        up = down = 0.0
        for a, b, k, back in zip(walk, walk[1:], c.seg_ids, c.reversed):
            _, u, v, _, x, y = by_id[k]
            assert (u, v) == ((b, a) if back else (a, b))
            up, down = up + (y if back else x), down + (x if back else y)
        assert (c.ascent_m, c.descent_m) == (up, down) and c.length_m == sum(by_id[k][3] for k in c.seg_ids)
        seen += c.seg_ids
    assert sorted(seen) == list(range(len(rows)))
    ends = sorted((c.u, c.v) for c in got)
    assert ends == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (50, 50)]


def test_edge_lookup_and_optional_tables(spark, tmp_path):
    edges = spark.range(5000).select(F.col("id").alias("edge_id"), F.array(F.col("id"), F.col("id") + 1).alias("points"), (F.col("id") * 2.0).alias("profile"))
    path = str(tmp_path / "edges")
    io.write_edges(edges, path)
    one = io.edge_of(spark, path, 4321, ["points"])
    assert one.collect() == [(4321, [4321, 4322])]
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(edge_id), EqualTo(edge_id,4321)]" in plan and "profile" not in plan.split("ReadSchema")[1]
    assert io.optional(spark, str(tmp_path / "none"), "a int").collect() == [] and io.optional(spark, path, "edge_id long").count() == 5000
    assert io.required(edges, "edge_id").count() == 5000
    with pytest.raises(Exception, match="a row without guid"):
        io.required(spark.createDataFrame([("x",), (None,)], "guid string"), "guid").collect()


def test_days_as_files(spark, tmp_path):
    days = spark.createDataFrame([(1, 2025, "2025-06-01", "SERVICED", 3, 20), (2, 2025, "2025-06-02", "CLOSED", None, 30)], "ohrs_id int, season int, date string, status string, free_place int, capacity int").withColumn("date", F.to_date("date"))
    io.write_days(days, str(tmp_path / "days"))
    assert sorted(map(str, io.read_days(spark, str(tmp_path / "days")).collect())) == sorted(map(str, days.collect()))


def test_requests():
    ran = []
    late = runs.Debounced(lambda x: ran.append(x) or x * 2, 0.05)
    for k in range(5):
        late.ask(k)
    assert late.wait() == 8 and ran == [4]
    late.ask(7)
    assert late.result == 8 and late.wait() == 14
    once, calls = runs.Once(), []

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("down")
        return len(calls)

    with pytest.raises(OSError):
        once.get("k", make)
    assert once.get("k", make) == once.get("k", make) == 2
    time.sleep(0.01)


def test_form(spark):
    classes = spark.createDataFrame([(1, "av", True), (2, "av", False), (3, "sonstige", True)], "hut_id long, operator string, serviced boolean")
    form = {"mode": "car", "classes": {"av:self", "sonstige:serviced"}, "leg_hours": 8.0, "leg_ascent": "", "greatest_height": "2800", "via_ferrata": False}
    q = app.query_of(form, classes, (3, 4))
    assert (q.mode, q.legs_min, q.legs_max, q.min_leg_h, q.max_leg_h, q.ascent_cap, q.max_ele, q.ferrata) == ("car", 3, 4, 4.0, 8.0, None, 2800.0, False)
    assert sorted(r.hut_id for r in q.allowed.collect()) == [2, 3]
    assert app.query_of({**form, "classes": set(), "leg_ascent": "many"}, classes, (2, 2)).allowed.count() == 0
    assert app.anchor_names(1) == ["a50_dlat", "a50_dlng"]
