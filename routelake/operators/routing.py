"""Shortest paths in cells: reach by distance, way by time.

A cell's edges and hubs come together in one group whose size the tiling bounds. Only huts are sources. A target counts as reached if
its shortest distance is within the limit; the stored way is the one of least time, and is tested again with the gaps to its hubs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATHS = "variant int, source long, target long, distance_m double, time_s double, ascent_m double, descent_m double, max_rank int, via_ferrata boolean, edge_ids array<long>, nodes array<long>"


def shortest(links: dict, source: int, weight: int, limit: float = float("inf"), wanted: Iterable[int] | None = None) -> tuple[dict, dict]:
    """(least weight, link into each node) from a source; links: node to (neighbour, weights…, place). With wanted nodes the walk ends when all of them are settled; what it says of others may not be final."""
    best, into, done, heap = {source: 0.0}, {}, set(), [(0.0, source)]
    left = None if wanted is None else set(wanted)
    while heap:
        d, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if left is not None:
            left.discard(node)
            if not left:
                break
        for link in links.get(node, ()):
            far = d + link[weight]
            if far <= limit and far < best.get(link[0], float("inf")):
                best[link[0]] = far
                into[link[0]] = (node, link)
                heapq.heappush(heap, (far, link[0]))
    return best, into


def _kernel(limit_m: float):
    def run(key: tuple, edges: pd.DataFrame, hubs: pd.DataFrame) -> pd.DataFrame:
        variant, rows = int(key[1]), []
        links: dict = {}
        if len(edges) and (edges["time_s"] < 0).any():
            raise ValueError("an edge has no routing time")
        for e in edges.itertuples():
            up = (e.ascent_m, e.descent_m, int(e.sac_rank), bool(e.via_ferrata), int(e.edge_id))
            links.setdefault(e.u, []).append((e.v, e.length_m, e.time_s, *up))
            links.setdefault(e.v, []).append((e.u, e.length_m, e.time_s, up[1], up[0], *up[2:]))
        targets = set(hubs["node"])
        for source in sorted(hubs.loc[hubs["is_hut"], "node"].unique()):
            near, _ = shortest(links, source, 1, limit_m)
            wanted = sorted(t for t in near if t != source and t in targets)
            if not wanted:
                continue
            times, into = shortest(links, source, 2, wanted=wanted)
            for t in wanted:
                path, node = [], t
                while node != source:
                    before, link = into[node]
                    path.append((before, node, link))
                    node = before
                path.reverse()
                length = sum(x[2][1] for x in path)
                if length <= limit_m:
                    rows.append((variant, source, t, length, times[t], sum(x[2][3] for x in path), sum(x[2][4] for x in path), max(x[2][5] for x in path), any(x[2][6] for x in path), [x[2][7] for x in path], [source, *(x[1] for x in path)]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PATHS.split(", ")])

    return run


def hub_paths(edges: DataFrame, hubs: DataFrame, limit_m: float) -> DataFrame:
    """Ways between hubs (cell_id, node, is_hut) over edges (cell_id, variant, edge_id, u, v, length_m, time_s, ascent_m, descent_m, sac_rank, via_ferrata), by cell and variant."""
    ends = edges.select("cell_id", F.col("variant").alias("variant"), F.explode(F.array("u", "v")).alias("node")).distinct()
    # Merged, as the size of hubs that are dealt over cells is not known beforehand; a hub without an edge has no way.
    each = hubs.hint("merge").join(ends, ["cell_id", "node"]).select("cell_id", "variant", "node", "is_hut")
    return edges.groupBy("cell_id", "variant").cogroup(each.groupBy("cell_id", "variant")).applyInPandas(_kernel(limit_m), PATHS)


def merged(paths: DataFrame) -> DataFrame:
    """One way for each unordered pair and variant: the fastest of all cells, then the least source; access ways are kept as they are."""
    keyed = paths.withColumns({"low": F.least("source", "target"), "high": F.greatest("source", "target")})
    best = Window.partitionBy("variant", "low", "high").orderBy("time_s", "source")
    return keyed.withColumn("rank_", F.row_number().over(best)).where("rank_ = 1").drop("rank_", "low", "high")


def relaxed(edges: DataFrame, sources: DataFrame, limit_m: float, rounds: int = 30) -> DataFrame:
    """(source, node, distance_m): shortest distances by rounds of joins, for graphs too large for a group; stops when a round changes nothing."""
    from routelake.plans.lineage import cut

    both = cut(edges.select("u", "v", "length_m").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m")).groupBy("u", "v").agg(F.min("length_m").alias("length_m")))
    best = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance_m")))
    front = best
    for _ in range(rounds):
        step = front.join(both, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("distance_m") + F.col("length_m")).alias("distance_m")).where(F.col("distance_m") <= limit_m)
        step = step.groupBy("source", "node").agg(F.min("distance_m").alias("distance_m"))
        known = best.select("source", "node", F.col("distance_m").alias("known"))
        front = cut(step.join(known, ["source", "node"], "left").where("known IS NULL OR distance_m < known").drop("known"))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("source", "node").agg(F.min("distance_m").alias("distance_m")))
    return best
