"""Analyses of the network: shares of road, grades by segment, the gate of connectivity, blockers, samples of pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.geo import haversine_m, point_code

#: Percentiles that are reported, budgets and caps of the gate.
PERCENTILES, CAPS, BUDGET_M = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), (2, 3), 30_000.0


def road_share(edges: DataFrame, thresholds: tuple[float, ...] = (0.25, 0.5)) -> DataFrame:
    """One row on the share road_m / distance_m of edges: weighted by length, mean, percentiles, counts at the ends and above thresholds."""
    share = F.coalesce(F.try_divide("road_m", "distance_m"), F.lit(0.0))
    rows = edges.withColumn("share", share)
    above = [F.count_if(F.col("share") > t).alias(f"above_{int(t * 100)}") for t in thresholds]
    return rows.agg(F.count("*").alias("n"), F.try_divide(F.sum("road_m"), F.sum("distance_m")).alias("aggregate"), F.avg("share").alias("mean"), F.percentile("share", F.array(*map(F.lit, PERCENTILES))).alias("percentiles"), F.count_if(F.col("share") <= 0).alias("road_free"), F.count_if(F.col("share") >= 0.999).alias("all_road"), *above)


def road_share_by_rank(edges: DataFrame) -> DataFrame:
    share = F.coalesce(F.try_divide("road_m", "distance_m"), F.lit(0.0))
    return edges.withColumn("share", share).groupBy("sac_rank").agg(F.count("*").alias("edges"), F.try_divide(F.sum("road_m"), F.sum("distance_m")).alias("aggregate"), F.median("share").alias("median"))


def _pair(lon1: str, lat1: str, lon2: str, lat2: str) -> tuple[Column, Column]:
    a, b = F.struct(*point_code(F.col(lon1), F.col(lat1))), F.struct(*point_code(F.col(lon2), F.col(lat2)))
    return F.least(a, b), F.greatest(a, b)


def strictest_segments(segments: DataFrame) -> DataFrame:
    """(p, q, tier, sac_rank, excluded) of segments (lon1, lat1, lon2, lat2, tier int, sac_rank, excluded) whatever their direction; of a pair that is there twice the strictest: tier, then excluded, then rank."""
    p, q = _pair("lon1", "lat1", "lon2", "lat2")
    keyed = segments.select(p.alias("p"), q.alias("q"), F.struct("tier", "excluded", "sac_rank").alias("s"))
    return keyed.groupBy("p", "q").agg(F.max("s").alias("s")).select("p", "q", "s.*")


def attributed(vertices: DataFrame, lookup: DataFrame) -> DataFrame:
    """Metres of each line (rec, pos, lon, lat) by tier of its segments (0 explicit, 1 inferred, 2 ungraded), excluded and unmatched, and the highest graded rank."""
    line = Window.partitionBy("rec").orderBy("pos")
    steps = vertices.withColumns({"lon2": F.lead("lon").over(line), "lat2": F.lead("lat").over(line)}).where("lon2 IS NOT NULL")
    p, q = _pair("lon", "lat", "lon2", "lat2")
    steps = steps.select("rec", p.alias("p"), q.alias("q"), haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("m"))
    joined = steps.join(lookup, ["p", "q"], "left")
    metres = lambda test: F.coalesce(F.sum(F.when(test, F.col("m"))), F.lit(0.0))
    rank = F.coalesce(F.max(F.when(F.col("tier") < 2, F.col("sac_rank"))), F.lit(-1))
    return joined.groupBy("rec").agg(F.sum("m").alias("total_m"), metres(F.col("tier") == 0).alias("explicit_m"), metres(F.col("tier") == 1).alias("inferred_m"), metres(F.col("tier") == 2).alias("ungraded_m"), metres(F.col("excluded")).alias("excluded_m"), metres(F.col("tier").isNull()).alias("unmatched_m"), rank.alias("max_rank"))


def attribution_summary(lines: DataFrame) -> DataFrame:
    share = F.col("ungraded_m") / F.greatest("total_m", F.lit(1.0))
    sums = [(F.sum(c) / 1000).alias(c.replace("_m", "_km")) for c in ("total_m", "explicit_m", "inferred_m", "ungraded_m", "excluded_m", "unmatched_m")]
    matched = 1 - F.try_divide(F.sum("unmatched_m"), F.sum("total_m"))
    return lines.agg(F.count("*").alias("edges"), matched.alias("matched"), *sums, F.count_if(F.col("ungraded_m") <= 0).alias("fully_graded"), F.percentile(share, F.array(*map(F.lit, PERCENTILES[2:]))).alias("ungraded_share"))


def connectivity_gate(edges: DataFrame, budget_m: float = BUDGET_M, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """(rule, edges, connected, isolated, mean_degree): how many huts keep a leg under a cap of grade, with and without the rule that all of it is graded. edges has (from_id, to_id, distance_m, sac_rank, via_ferrata, ungraded_m, excluded_m, max_rank). All rules are marked on one scan."""
    near = F.col("distance_m") <= budget_m
    capped = {f"cap_{c}": near & ~F.col("via_ferrata") & (F.col("sac_rank") <= c) for c in caps}
    graded = {f"cap_{c}_graded": capped[f"cap_{c}"] & (F.col("ungraded_m") <= 0) & (F.col("excluded_m") <= 0) & (F.col("max_rank") <= c) for c in caps}
    rules = {"budget": near} | capped | graded
    marked = edges.select("from_id", "to_id", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    connected = marked.select("rule", F.explode(F.array("from_id", "to_id")).alias("hut")).groupBy("rule").agg(F.countDistinct("hut").alias("connected"))
    counted = marked.groupBy("rule").agg(F.count("*").alias("edges"))
    huts = edges.select(F.explode(F.array("from_id", "to_id")).alias("hut")).agg(F.countDistinct("hut").alias("huts"))
    names = edges.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    out = names.join(counted, "rule", "left").join(connected, "rule", "left").crossJoin(huts).na.fill(0)  # one row of huts
    return out.select("rule", "edges", "connected", (F.col("huts") - F.col("connected")).alias("isolated"), (2 * F.col("edges") / F.greatest("connected", F.lit(1))).alias("mean_degree"))


def edge_impact(records: DataFrame, hubs: DataFrame) -> DataFrame:
    """(variant, records, touching): records with an end among hubs (hub_id)."""
    ids = hubs.select(F.col("hub_id").alias("id_")).distinct()
    hit = records.join(ids, (F.col("from_id") == F.col("id_")), "left_semi").unionByName(records.join(ids, F.col("to_id") == F.col("id_"), "left_semi")).distinct()
    return records.groupBy("variant").agg(F.count("*").alias("records")).join(hit.groupBy("variant").agg(F.count("*").alias("touching")), "variant", "left").na.fill(0, ["touching"])


def blocker(without_grades: Column, without_ceiling: Column) -> Column:
    """Why a pair has no way: what alone would open one."""
    return F.when(without_grades & ~without_ceiling, "ungraded").when(~without_grades & without_ceiling, "difficulty").when(without_grades & without_ceiling, "combined").otherwise("disconnected")


def substitutions(base: DataFrame, other: DataFrame) -> DataFrame:
    """(pairs, substituted): pairs (source, target, nodes) whose way is another one than the base's."""
    joined = base.select("source", "target", F.col("nodes").alias("a")).join(other.select("source", "target", F.col("nodes").alias("b")), ["source", "target"])
    return joined.agg(F.count("*").alias("pairs"), F.count_if(F.col("a") != F.col("b")).alias("substituted"))


def spread_by_cell(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("cell_id").agg((F.max("ele") - F.min("ele")).alias("spread_m"))


def pair_sample(pairs: DataFrame, strata: int, of_each: int, seed: int = 42) -> DataFrame:
    """So many pairs (source, target, distance_m) of each stratum of distance, by a seeded hash. Strata are equal parts of the range, so no global sort is needed."""
    low, high = pairs.agg(F.min("distance_m"), F.max("distance_m")).first()
    width = ((high or 0) - (low or 0)) / strata or 1.0
    marked = pairs.withColumn("stratum", F.least(F.floor((F.col("distance_m") - (low or 0)) / width), F.lit(strata - 1)).cast("int"))
    draw = Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed), "source", "target"), "source", "target")
    return marked.withColumn("n_", F.row_number().over(draw)).where(F.col("n_") <= of_each).drop("n_")


def k_best(starts: DataFrame, k: int, dropped: tuple[str, ...] = ("private", "no")) -> DataFrame:
    """The k nearest starts of each hut (hut_id, start_type, distance_m, access, edge_id), none with dropped access; if all are of one type, the nearest of another type takes the place of the last. The swap is sequential, so it is a fold over a hut's rows."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["distance_m", "edge_id"], kind="stable")
        best, rest = rows.iloc[:k], rows.iloc[k:]
        other = rest[~rest["start_type"].isin(best["start_type"])]
        if len(best) == k > 1 and best["start_type"].nunique() == 1 and len(other):
            best = pd.concat([best.iloc[:-1], other.iloc[:1]])
        return best

    kept = starts.where(~F.coalesce(F.col("access").isin(*dropped), F.lit(False)))
    return kept.groupBy("hut_id").applyInPandas(fold, kept.schema)
