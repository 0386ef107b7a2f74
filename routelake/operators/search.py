"""Search of tours: layers of states (hut, start, visited huts), filtered, pruned by dominance and closed by exit legs.

One DataFrame per layer; a layer is persisted, as the next one and its own exits read it, and so are the legs that all layers join. Legs join on the hut; all tests of a leg
are one CASE, so that the counter of the first failing test is right and later, dearer tests run on survivors only. Of states with
one hut, start and set of visited huts the one of least duration survives, the first of equals. Order is carried as an array: first
sighting of the hut, then of the state's key, then the leg's place, which is the order in which nested maps would yield them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.operators.legs import backward, kill_reason
from routelake.schema import MODE_SOURCE

MOST_LEGS = 8
#: Why a leg or tour is dropped.
REASONS = ("max_leg_time", "min_leg_time", "leg_ascent_cap", "max_ele", "via_ferrata", "hut_filtered", "availability", "revisit", "track_overlap")
SIMILAR = 0.5
_NO_IDS = "CAST(array() AS array<int>)"


@dataclass(frozen=True)
class Query:
    mode: str = "transit"
    legs_min: int = 2
    legs_max: int = 4
    variant: int = 0
    max_leg_h: float = 8.0
    min_leg_h: float = 0.0
    ascent_cap: float | None = None
    max_ele: float | None = None
    ferrata: bool = True
    with_ids: bool = False
    #: Whether tours list their legs; totals and huts are there in any case.
    with_legs: bool = True
    allowed: DataFrame | None = field(default=None, compare=False)
    #: (hut_id, night, free): a missing row is unknown and passes.
    beds: DataFrame | None = field(default=None, compare=False)

    def reason(self) -> Column:
        return kill_reason(self.max_leg_h, self.min_leg_h, self.ascent_cap, self.max_ele, self.ferrata)


def common_run(a: Column, b: Column) -> Column:
    """The neighbours' common ids out of their shared point, up to the first that differ."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(a, i - 1) != F.get(b, i - 1))
    return F.slice(a, F.lit(1), F.when(n <= 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)))


def overlaps(new: Column, exempt: Column, used: Column) -> Column:
    return F.arrays_overlap(F.array_except(new, exempt), used)


def _beds(legs: DataFrame, query: Query, night: int) -> DataFrame:
    """Adds full: a confirmed night without beds at to_hut."""
    if query.beds is None:
        return legs.withColumn("full_", F.lit(False))
    beds = query.beds.where((F.col("night") == night) & ~F.col("free")).select(F.col("hut_id").alias("bed_hut")).distinct()
    return legs.join(beds, legs.to_hut == beds.bed_hut, "left").withColumn("full_", F.col("bed_hut").isNotNull()).drop("bed_hut")


def _allowed(legs: DataFrame, query: Query) -> DataFrame:
    if query.allowed is None:
        return legs.withColumn("barred_", F.lit(False))
    huts = query.allowed.select(F.col("hut_id").alias("ok_hut")).distinct()
    return legs.join(huts, legs.to_hut == huts.ok_hut, "left").withColumn("barred_", F.col("ok_hut").isNull()).drop("ok_hut")


def _leg() -> Column:
    return F.struct("duration_h", "ascent_m", "descent_m", "distance_m", "edge_id", "reversed")


def _dominant(states: DataFrame) -> DataFrame:
    """Of the states of one hut, start and visited huts the one of least duration, the first of equals; its place is that of the hut's first sighting, then the key's. A hut's first sighting is a partial minimum, so a hut with many states is no task of its own."""
    key = ["hut", "start_id", "visited"]
    best = Window.partitionBy(*key).orderBy("total_h", "ord")
    states = states.withColumn("key_", F.min("ord").over(Window.partitionBy(*key))).withColumn("rank_", F.row_number().over(best)).where("rank_ = 1").drop("rank_").persist()
    first = states.groupBy(F.col("hut").alias("hut_")).agg(F.min("key_").alias("first_"))
    return states.join(first, F.col("hut") == F.col("hut_")).withColumn("ord", F.concat("first_", "key_")).drop("hut_", "key_", "first_")


def _with_ids(legs: DataFrame, ids: DataFrame | None, query: Query) -> DataFrame:
    """Adds leg_ids and the runs near either end (prefix at the edge's from, suffix at its to)."""
    if not query.with_ids or ids is None:
        return legs.withColumns({"leg_ids": F.expr(_NO_IDS), "prefix": F.expr(_NO_IDS), "suffix": F.expr(_NO_IDS)})
    return legs.join(ids.withColumnRenamed("ids", "leg_ids"), "edge_id", "left")


def search(query: Query, approaches: DataFrame, exits: DataFrame, adjacency: DataFrame, hut_ids: DataFrame | None = None, start_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tours, kills). approaches and exits: (hut_id, start_id, start_type, variant, edge_id, distance_m, ascent_m, descent_m[, duration_h]) stored from start to hut; adjacency: directed legs of the query's variant. Tours: start_id, exit_start_id, huts, legs, totals and place, in order of total_h."""
    if query.legs_max > MOST_LEGS:
        raise ValueError(f"at most {MOST_LEGS} legs")
    source = MODE_SOURCE[query.mode]
    unknown = {c: F.lit(None).cast(t) for c, t in (("max_ele_m", "double"), ("via_ferrata", "boolean"))}
    fitting = lambda df: df if source is None else df.where(F.col("start_type") == source)
    kills = []
    seeds = fitting(approaches).withColumns({"to_hut": F.col("hut_id"), "reversed": F.lit(False)} | {k: v for k, v in unknown.items() if k not in approaches.columns})
    seeds = _beds(_allowed(_with_ids(seeds, start_ids, query), query), query, 1)
    seeds = seeds.withColumn("reason", F.when(F.col("barred_"), "hut_filtered").when(F.col("full_"), "availability").otherwise(query.reason()))
    kills.append(seeds.where("reason IS NOT NULL").select("reason"))
    layer = seeds.where("reason IS NULL").select(
        F.col("hut_id").alias("hut"), "start_id", F.array("hut_id").alias("path"), F.array("hut_id").alias("visited"), F.col("duration_h").alias("total_h"),
        F.col("ascent_m").alias("total_ascent_m"), F.col("descent_m").alias("total_descent_m"), F.col("distance_m").alias("total_distance_m"), *[F.array(_leg()).alias("legs")] * query.with_legs,
        F.col("leg_ids").alias("used"), F.col("suffix").alias("arrived"), F.col("prefix").alias("left_start"), F.array("hut_id", "edge_id").alias("ord"),
    )
    layer = _dominant(layer)
    out_legs = backward(fitting(exits).where(F.col("variant") == query.variant)).withColumns({k: v for k, v in unknown.items() if k not in exits.columns})
    out_legs = _with_ids(out_legs, start_ids, query).withColumn("reason", query.reason())
    out_legs = out_legs.select(F.col("hut_id").alias("x_hut"), F.col("start_id").alias("exit_start_id"), *[c for c in out_legs.columns if c not in ("hut_id", "start_id", "start_type", "variant", "access")]).persist()
    steps = _with_ids(adjacency, hut_ids, query).withColumn("reason", query.reason()).withColumn("to_hut", F.col("to_id"))
    steps = _allowed(steps, query).persist()
    finished = []

    def finish(layer: DataFrame, n: int) -> None:
        if n < query.legs_min - 1:
            return
        closed = layer.join(out_legs, (F.col("hut") == F.col("x_hut")) & (F.lit(query.mode != "car") | (F.col("exit_start_id") == F.col("start_id"))))
        if query.with_ids:
            home = F.when(F.col("exit_start_id") == F.col("start_id"), common_run(F.col("left_start"), F.col("prefix"))).otherwise(F.expr(_NO_IDS))
            exempt = F.array_union(common_run(F.col("arrived"), F.col("suffix")), home)
            closed = closed.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(overlaps(F.col("leg_ids"), exempt, F.col("used")), "track_overlap"))
        kills.append(closed.where("reason IS NOT NULL").select("reason"))
        finished.append(closed.where("reason IS NULL").select(
            "start_id", "exit_start_id", F.col("path").alias("huts"), *[F.concat("legs", F.array(_leg())).alias("legs")] * query.with_legs, (F.col("total_h") + F.col("duration_h")).alias("total_h"),
            (F.col("total_ascent_m") + F.col("ascent_m")).alias("total_ascent_m"), (F.col("total_descent_m") + F.col("descent_m")).alias("total_descent_m"),
            (F.col("total_distance_m") + F.col("distance_m")).alias("total_distance_m"), F.concat(F.array(F.lit(n).cast("long")), "ord", F.array("edge_id")).alias("place"),
        ))

    finish(layer, 1)
    for n in range(1, query.legs_max - 1):
        legs = _beds(steps, query, n + 1).select(F.col("from_id").alias("f_hut"), "to_hut", "edge_id", "reversed", "duration_h", "ascent_m", "descent_m", "distance_m", "reason", "leg_ids", "prefix", "suffix", "barred_", "full_", F.col("ord").alias("leg_ord"))
        grown = layer.join(legs, F.col("hut") == F.col("f_hut"))
        reason = F.when(F.col("barred_"), "hut_filtered").when(F.array_contains("path", F.col("to_hut")), "revisit").when(F.col("full_"), "availability").when(F.col("reason").isNotNull(), F.col("reason"))
        if query.with_ids:
            departing = F.when(F.col("reversed"), F.col("suffix")).otherwise(F.col("prefix"))
            reason = reason.when(overlaps(F.col("leg_ids"), common_run(F.col("arrived"), departing), F.col("used")), "track_overlap")
        grown = grown.withColumn("reason", reason)
        kills.append(grown.where("reason IS NOT NULL").select("reason"))
        grown = grown.where("reason IS NULL").select(
            F.col("to_hut").alias("hut"), "start_id", F.concat("path", F.array("to_hut")).alias("path"), F.array_sort(F.concat("visited", F.array("to_hut"))).alias("visited"),
            (F.col("total_h") + F.col("duration_h")).alias("total_h"), (F.col("total_ascent_m") + F.col("ascent_m")).alias("total_ascent_m"), (F.col("total_descent_m") + F.col("descent_m")).alias("total_descent_m"),
            (F.col("total_distance_m") + F.col("distance_m")).alias("total_distance_m"), *[F.concat("legs", F.array(_leg())).alias("legs")] * query.with_legs, (F.array_union("used", "leg_ids") if query.with_ids else F.col("used")).alias("used"),
            F.when(F.col("reversed"), F.col("prefix")).otherwise(F.col("suffix")).alias("arrived"), "left_start", F.concat("ord", F.array("leg_ord")).alias("ord"),
        )
        layer = _dominant(grown)
        finish(layer, n + 1)
    reasons = out_legs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, REASONS))).alias("reason"))
    counted = reasons.join(reduce(DataFrame.unionByName, kills).groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").na.fill(0, ["n"])
    if not finished:
        raise ValueError("legs_min is above legs_max")
    return reduce(DataFrame.unionByName, finished), counted


def in_order(tours: DataFrame) -> DataFrame:
    return tours.orderBy("total_h", "place")


def without_reverse_pairs(tours: DataFrame) -> DataFrame:
    """Of tours with one hut sequence, or its reverse, the fastest, the first of equals; at the place of the first sighting."""
    ahead, back = F.array_join(F.col("huts").cast("array<string>"), ">"), F.array_join(F.reverse(F.col("huts").cast("array<string>")), ">")
    keyed = tours.withColumn("key_", F.least(ahead, back))
    seen = F.struct("total_h", "place")
    rank = F.row_number().over(Window.partitionBy("key_").orderBy("total_h", seen))
    first = F.min(seen).over(Window.partitionBy("key_"))
    return keyed.withColumns({"rank_": rank, "seen": first}).where("rank_ = 1").drop("rank_", "key_")


def hut_overlap(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def without_similar(tours: DataFrame, scope: str = "per_start") -> DataFrame:
    """Greedy: a tour in order of total_h stays if no kept one shares more than half of the smaller set of huts. per_start compares tours of one start alone; global also keeps one tour a start. The rule is sequential, so it is a fold over a group."""

    columns = tours.columns

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(p_=[tuple(p) for p in rows["place"]]).sort_values(["total_h", "p_"], kind="stable")
        kept: list[tuple[int, set]] = []
        out = []
        for i, start, huts in zip(rows.index, rows["start_id"], rows["huts"], strict=True):
            own = set(huts)
            like = any((scope == "global" and s == start) or len(own & o) / min(len(own), len(o)) > SIMILAR for s, o in kept)
            if not like:
                kept.append((start, own))
                out.append(i)
        return rows.loc[out][columns]

    if scope == "per_start":
        return tours.groupBy("start_id").applyInPandas(fold, tours.schema)
    # The scope of the whole result is one group by its definition; it holds the tours of one search.
    return tours.withColumn("all_", F.lit(0)).groupBy("all_").applyInPandas(fold, tours.schema)


def find_tours(query: Query, approaches: DataFrame, exits: DataFrame, adjacency: DataFrame, hut_ids=None, start_ids=None, scope: str = "per_start") -> DataFrame:
    tours, _ = search(query, approaches, exits, adjacency, hut_ids, start_ids)
    return without_similar(without_reverse_pairs(tours).drop("seen"), scope)


def fit_score(target: int, leg_range: tuple[int, int], hours_range: tuple[float, float], night_states: Column | None = None) -> Column:
    """Lower fits better: legs off the target, hours off the middle of the range, uneven legs, nights without beds. Fixed weights 1, 1, 0.5 and 2."""
    middle, scale = sum(hours_range) / 2, max(0.5, (hours_range[1] - hours_range[0]) / 2)
    h = F.transform("legs", lambda x: x["duration_h"])
    n = F.size(h)
    total = lambda f: F.aggregate(h, F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x) / n
    off = total(lambda x: F.abs(x - middle)) / n / scale
    uneven = F.sqrt(total(lambda x: (x - mean) * (x - mean)) / n) / scale
    score = F.abs(n - target) / max(1, leg_range[1] - leg_range[0]) + off + 0.5 * uneven
    if night_states is not None:
        penalty = F.aggregate(night_states, F.lit(0.0), lambda a, x: a + F.when(x == "full", 1.0).when(x == "unknown", 0.5).otherwise(0.0))
        score = score + F.when(F.size(night_states) > 0, 2 * penalty / F.size(night_states)).otherwise(0.0)
    return score


def sorted_tours(tours: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By fit (score, place), or by duration, ascent or distance; descending is the exact reverse, ties included."""
    if key == "fit":
        return tours.orderBy("score", "place")
    column = {"duration": "total_h", "ascent": "total_ascent_m", "distance": "total_distance_m"}[key]
    return tours.orderBy(F.desc(column), F.desc("place")) if descending else tours.orderBy(column, "place")


def by_start(tours: DataFrame) -> DataFrame:
    """(start_id, n, first place): groups in order of first sighting."""
    return tours.groupBy("start_id").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def best_start(tours: DataFrame) -> DataFrame:
    """The start with most tours, the least id of equals."""
    return by_start(tours).agg(F.max_by("start_id", F.struct("n", (-F.col("start_id")).alias("back"))).alias("start_id"))


def indexed(tours: DataFrame) -> DataFrame:
    """(kind, key, tours): which tours (tour_id) use a leg, a hut or an end; huts are nodes of the path start, huts, exit."""
    points = F.concat(F.array(F.concat(F.lit("s"), F.col("start_id"))), F.transform("huts", lambda h: F.concat(F.lit("h"), h)), F.array(F.concat(F.lit("s"), F.col("exit_start_id"))))
    legs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.array_join(F.array_sort(F.array(a, b)), "-"))
    parts = [tours.select(F.lit(kind).alias("kind"), "tour_id", F.explode(keys).alias("key")) for kind, keys in (("leg", legs), ("hut", F.transform("huts", lambda h: h.cast("string"))), ("end", F.array(F.col("start_id").cast("string"), F.col("exit_start_id").cast("string"))))]
    return reduce(DataFrame.unionByName, parts).distinct().groupBy("kind", "key").agg(F.array_sort(F.collect_list("tour_id")).alias("tours"))


def touching(tours: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Tours whose bounding box (points array<struct<lon, lat>>) touches a viewport."""
    side = lambda name, f: f(F.transform("points", lambda p: p[name]))
    return tours.where((side("lon", F.array_max) >= box[0]) & (side("lon", F.array_min) <= box[2]) & (side("lat", F.array_max) >= box[1]) & (side("lat", F.array_min) <= box[3]))

