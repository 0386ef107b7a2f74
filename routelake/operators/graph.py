"""The network as a graph: degrees, contraction of chains, components, local subgraphs, splits at snapped hubs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions import geo
from routelake.plans.lineage import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of edges (u, v); a loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, component): the least node that each node of edges (u, v) reaches within its keys. Labels go to neighbours and labels of labels are taken over in each round, so long chains need few rounds."""
    keys = keys or []
    both = cut(edges.select(*keys, "u", "v").unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("label"))
    before = None
    while True:
        labels = cut(labels)
        state = labels.agg(F.sum(F.xxhash64(*keys, "u", "label").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels.select(*keys, F.col("u").alias("node"), F.col("label").alias("component"))
        before = state
        heard = both.join(labels.select(*keys, F.col("u").alias("v"), F.col("label").alias("heard")), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("heard").alias("heard"))
        near = labels.join(heard, [*keys, "u"]).select(*keys, "u", F.least("label", "heard").alias("label"))
        of = near.select(*keys, F.col("u").alias("label"), F.col("label").alias("further"))
        labels = near.join(of, [*keys, "label"], "left").select(*keys, "u", F.least("label", F.coalesce("further", "label")).alias("label"))


def contracted(segments: DataFrame) -> DataFrame:
    """Chains of segments (seg_id, u, v, length_m, sac_rank, via_ferrata, downgraded, constrained_ok) between nodes whose degree is not two: (chain, u, v, folds, segs). Lengths add up, the rank is the highest, flags are joined by or, constrained_ok by and. A ring without such a node closes at its least node.

    Segments that meet in a node of degree two are linked; the components of these links are the chains."""
    junction = degrees(segments).where("degree != 2").select("node")
    ends = segments.select("seg_id", F.explode(F.array("u", "v")).alias("node"))
    inner = ends.join(junction, "node", "left_anti")
    pair = inner.groupBy("node").agg(F.min("seg_id").alias("u"), F.max("seg_id").alias("v"))
    chains = components(pair.where("u != v").select("u", "v"))
    labelled = segments.join(chains.withColumnRenamed("node", "seg_id"), "seg_id", "left").withColumn("chain", F.coalesce("component", "seg_id"))
    tips = labelled.select("chain", F.explode(F.array("u", "v")).alias("node")).join(junction, "node", "left_semi").groupBy("chain").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    folds = labelled.groupBy("chain").agg(
        F.sum("length_m").alias("length_m"), F.max("sac_rank").alias("sac_rank"), F.bool_or("via_ferrata").alias("via_ferrata"), F.bool_or("downgraded").alias("downgraded"),
        F.bool_and("constrained_ok").alias("constrained_ok"), F.count("*").alias("segs"), F.min(F.least("u", "v")).alias("ring_node"),
    )
    joined = folds.join(tips, "chain", "left")
    return joined.select("chain", F.coalesce("u", "ring_node").alias("u"), F.coalesce("v", "ring_node").alias("v"), "length_m", "sac_rank", "via_ferrata", "downgraded", "constrained_ok", "segs")


def raw_segments(chains: DataFrame) -> DataFrame:
    """The inverse: (edge_id, pos, a, b) of consecutive points u, interior, v of chains (edge_id, u_point, v_point, interior)."""
    points = F.concat(F.array("u_point"), "interior", F.array("v_point"))
    pairs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return chains.select("edge_id", F.posexplode(pairs).alias("pos", "p")).select("edge_id", "pos", "p.a", "p.b")


def subgraph(nodes: DataFrame, edges: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the given cells and one step beyond: edges with an end inside, and the nodes at their ends."""
    inside = nodes.join(cells, "cell_id", "left_semi").select("node_id")
    touched = edges.join(inside, F.col("u") == F.col("node_id"), "left_semi").union(edges.join(inside, F.col("v") == F.col("node_id"), "left_semi")).distinct()
    wanted = touched.select(F.explode(F.array("u", "v")).alias("node_id")).union(inside).distinct()
    return nodes.join(wanted, "node_id", "left_semi"), touched


def split_edges(edges: DataFrame, splits: DataFrame, split_time: str = "reference") -> DataFrame:
    """Edges (edge_id, u, v, length_m, time_s, …) with those of splits (edge_id, hub_node, share) in two halves of ids 3e+1 and 3e+2; others have 3e. Each hub splits the original edge. With split_time reference a half takes its metres as seconds and has no climbs; with share it takes its share of all."""
    kept = edges.join(splits.select("edge_id").distinct(), "edge_id", "left_anti").withColumn("edge_id", F.col("edge_id") * 3)
    cut_ = edges.join(splits, "edge_id")
    part = lambda k, a, b, s: F.struct((F.col("edge_id") * 3 + k).alias("edge_id"), a.alias("u"), b.alias("v"), (F.col("length_m") * s).alias("length_m"), (F.col("length_m") * s if split_time == "reference" else F.col("time_s") * s).alias("time_s"), *[(F.lit(0.0) if split_time == "reference" else F.col(c) * s).alias(c) for c in ("ascent_m", "descent_m") if c in edges.columns])
    named = ("edge_id", "u", "v", "length_m", "time_s", "ascent_m", "descent_m")
    rest = [c for c in edges.columns if c not in named]
    halves = cut_.select(F.explode(F.array(part(1, F.col("u"), F.col("hub_node"), F.col("share")), part(2, F.col("hub_node"), F.col("v"), 1 - F.col("share")))).alias("h"), *rest)
    return kept.unionByName(halves.select("h.*", *rest))


def cells_by_density(nodes: DataFrame) -> DataFrame:
    """(cell_id, n, running): cells from the densest on with the running number of nodes."""
    counted = nodes.groupBy("cell_id").agg(F.count("*").alias("n"))
    return counted.withColumn("running", F.sum("n").over(Window.orderBy(F.desc("n"), "cell_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def cells_covering(nodes: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, cells): how many of the densest cells hold so much of all nodes."""
    dense = cells_by_density(nodes).withColumns({"k": F.row_number().over(Window.orderBy(F.desc("n"), "cell_id")), "total": F.sum("n").over(Window.partitionBy())})
    each = dense.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    return each.where(F.col("running") >= F.col("fraction") * F.col("total")).groupBy("fraction").agg(F.min("k").cast("long").alias("cells"))


def candidate_hubs(hubs: DataFrame, box: tuple[float, float, float, float], tile_km: float, reach_km: float) -> DataFrame:
    """(cell_id, hub_type, hub_id, is_hut): for each cell that holds a hut, the hubs (hub_type, hub_id, lon, lat) that a way of the given length can reach: those in the cell's box widened by it. is_hut: a hut of the cell itself."""
    x, y = F.col("lon"), F.col("lat")
    own = hubs.withColumn("own", geo.grid_cell(x, y, *box, tile_km))
    west, south, east, north = geo.cell_bounds(F.col("cell_id"), *box, tile_km, reach_km)
    around = geo.cell_bounds(F.col("own"), *box, tile_km, reach_km)
    cells = own.where("hub_type = 0").select(F.col("own").alias("cell_id")).distinct()
    each = own.withColumn("cell_id", F.explode(geo.cells_over(*around, *box, tile_km)))
    near = each.join(cells, "cell_id", "left_semi").where((x >= west) & (x <= east) & (y >= south) & (y <= north))
    return near.select("cell_id", "hub_type", "hub_id", ((F.col("hub_type") == 0) & (F.col("own") == F.col("cell_id"))).alias("is_hut"))


def clipped(nodes: DataFrame, edges: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a box and one step beyond: nodes (node_id, lon, lat) inside, edges (u, v) that touch one, and the nodes at their ends."""
    inside = nodes.where(geo.in_box(F.col("lon"), F.col("lat"), box)).select("node_id", F.lit(0).alias("cell_id"))
    both = subgraph(inside.unionByName(nodes.join(inside, "node_id", "left_anti").select("node_id", F.lit(1).alias("cell_id"))), edges, inside.select("cell_id").distinct())
    return nodes.join(both[0].select("node_id"), "node_id", "left_semi"), both[1]


def ordered_chains(segments: DataFrame) -> DataFrame:
    """(chain, u, v, interior, seg_ids, reversed, length_m, ascent_m, descent_m) of segments (seg_id, u, v, length_m, ascent_m, descent_m): the chains of contracted() walked from their end of least node, with the nodes between and the climbs in the direction of the walk. A ring starts at its least node, along the least segment there.

    Labels find the chains in parallel; a chain itself is one walk, as long as a path without crossings."""
    out = "chain long, u long, v long, interior array<long>, seg_ids array<long>, reversed array<boolean>, length_m double, ascent_m double, descent_m double"

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        at: dict[int, list] = {}
        for r in sorted(rows.itertuples(), key=lambda r: r.seg_id):
            at.setdefault(r.u, []).append(r)
            if r.v != r.u:
                at.setdefault(r.v, []).append(r)
        tips = sorted({r.u for r in rows.itertuples() if r.u_tip} | {r.v for r in rows.itertuples() if r.v_tip})
        node = first = tips[0] if tips else min(at)
        path, done = [], set()
        while step := next((r for r in at[node] if r.seg_id not in done), None):
            back = node != step.u
            path.append((step, back))
            done.add(step.seg_id)
            node = step.u if back else step.v
            if node == first or node in tips:
                break
        nodes = [s.u if back else s.v for s, back in path]
        up, down = (sum(float(getattr(s, a if not back else b)) for s, back in path) for a, b in (("ascent_m", "descent_m"), ("descent_m", "ascent_m")))
        row = (int(rows["chain"].iloc[0]), first, node, nodes[:-1], [s.seg_id for s, _ in path], [back for _, back in path], sum(float(s.length_m) for s, _ in path), up, down)
        return pd.DataFrame([row], columns=[c.split()[0] for c in out.split(", ")])

    junction = degrees(segments).where("degree != 2").select("node")
    inner = segments.select("seg_id", F.explode(F.array("u", "v")).alias("node")).join(junction, "node", "left_anti")
    pair = inner.groupBy("node").agg(F.min("seg_id").alias("u"), F.max("seg_id").alias("v"))
    chains = components(pair.where("u != v").select("u", "v"))
    labelled = segments.join(chains.withColumnRenamed("node", "seg_id"), "seg_id", "left").withColumn("chain", F.coalesce("component", "seg_id")).drop("component")
    for end in ("u", "v"):
        labelled = labelled.join(junction.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_tip")), end, "left").na.fill(False, [f"{end}_tip"])
    return labelled.groupBy("chain").applyInPandas(walk, out)


def by_workload(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(cell_id, score, place): cells from the most work on: edges (cell_id) times huts among hubs (cell_id, is_hut), one at least."""
    huts = hubs.where("is_hut").groupBy("cell_id").agg(F.count("*").alias("huts"))
    scored = edges.groupBy("cell_id").agg(F.count("*").alias("edges")).join(huts, "cell_id", "left").withColumn("score", F.col("edges") * F.coalesce("huts", F.lit(1)))
    return scored.select("cell_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "cell_id")).alias("place"))  # a row a cell


def gathered(runs: DataFrame, flat: DataFrame) -> DataFrame:
    """(key, values): runs (key, start, n) of a flat table (i, value), in order."""
    each = runs.where("n > 0").select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i")).join(flat, "i")
    lists = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("l"))
    out = runs.select("key").join(lists, "key", "left")
    return out.select("key", F.coalesce(F.col("l.value"), F.array().cast(f"array<{flat.schema['value'].dataType.simpleString()}>")).alias("values"))
