"""Editing a trip: legs between its stops, ends that connect it, and candidates for changes.

trips: (trip_id, start_type, start_id, exit_id, huts array<bigint>). approaches and exits are start legs (hut_id, start_id, start_type,
variant, edge_id, duration_h), the exits walked from the hut; adjacency holds directed hut legs of one variant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.operators.legs import best_start_legs
from routelake.operators.search import common_run, overlaps
from routelake.schema import PARKING, PARTNER


def mode_of(start_type: Column) -> Column:
    return F.when(start_type == PARKING, "car").when(start_type == PARTNER, "village").otherwise("transit")


def fastest_legs(adjacency: DataFrame) -> DataFrame:
    """(from_id, to_id, duration_h, edge_id, reversed): the fastest leg of each pair, the first of equals."""
    best = F.min_by(F.struct("duration_h", "edge_id", "reversed"), F.struct("duration_h", "ord"))
    return adjacency.groupBy("from_id", "to_id").agg(best.alias("b")).select("from_id", "to_id", "b.*")


def _ends(legs: DataFrame, variant: int, prefix: str) -> DataFrame:
    best = best_start_legs(legs, variant)
    return best.select(F.col("hut_id").alias(f"{prefix}_hut"), F.col("start_type").alias(f"{prefix}_type"), F.col("start_id").alias(f"{prefix}_point"), F.col("duration_h").alias(f"{prefix}_h"))


def connected(sequences: DataFrame, approaches: DataFrame, exits: DataFrame, variant: int) -> DataFrame:
    """(seq_id, new_start, new_exit) of sequences (seq_id, start_type, start_id, exit_id, huts) whose ends can be reached: the present ends where they still link, else the fastest of their type; by car one point that links to both ends. Others are left out."""
    a, b = _ends(approaches, variant, "a"), _ends(exits.where(F.col("variant") == variant), variant, "b")
    base = sequences.where(F.size("huts") > 0).select("seq_id", "start_type", "start_id", "exit_id", F.element_at("huts", 1).alias("first"), F.element_at("huts", -1).alias("last"))
    car = base.where(mode_of(F.col("start_type")) == "car")
    both = car.join(a, (F.col("first") == F.col("a_hut")) & (F.col("start_type") == F.col("a_type"))).join(b, (F.col("last") == F.col("b_hut")) & (F.col("start_type") == F.col("b_type")) & (F.col("a_point") == F.col("b_point")))
    order = F.struct((F.col("a_point") != F.col("start_id")).alias("other"), (F.col("a_h") + F.col("b_h")).alias("total"), F.col("a_point").alias("point"))
    by_car = both.groupBy("seq_id").agg(F.min(order).alias("m")).select("seq_id", F.col("m.point").alias("new_start"), F.col("m.point").alias("new_exit"))
    rest = base.where(mode_of(F.col("start_type")) != "car")

    def best(legs: DataFrame, prefix: str, hut: str, own: str, name: str) -> DataFrame:
        found = rest.join(legs, (F.col(hut) == F.col(f"{prefix}_hut")) & (F.col("start_type") == F.col(f"{prefix}_type")))
        order = F.struct((F.col(f"{prefix}_point") != F.col(own)).alias("other"), F.col(f"{prefix}_h").alias("h"), F.col(f"{prefix}_point").alias("point"))
        return found.groupBy("seq_id").agg(F.min(order).alias("m")).select("seq_id", F.col("m.point").alias(name))

    others = best(a, "a", "first", "start_id", "new_start").join(best(b, "b", "last", "exit_id", "new_exit"), "seq_id")
    return by_car.unionByName(others)


def swap_candidates(trips: DataFrame, adjacency: DataFrame, approaches: DataFrame, exits: DataFrame, variant: int) -> DataFrame:
    """(trip_id, pos, hut_id, in_h, out_h): huts outside the trip that link to both neighbours of each stop."""
    points = trips.select("*", F.posexplode("huts").alias("pos", "hut"))
    points = points.withColumns({"prev": F.get("huts", F.col("pos") - 1), "next": F.get("huts", F.col("pos") + 1)})
    legs = fastest_legs(adjacency)
    a, b = _ends(approaches, variant, "a"), _ends(exits.where(F.col("variant") == variant), variant, "b")
    key = ["trip_id", "pos"]
    from_hut = points.where("prev IS NOT NULL").join(legs, F.col("prev") == F.col("from_id")).select(*key, F.col("to_id").alias("cand"), F.col("duration_h").alias("in_h"))
    from_start = points.where("prev IS NULL").join(a, (F.col("start_id") == F.col("a_point")) & (F.col("start_type") == F.col("a_type"))).select(*key, F.col("a_hut").alias("cand"), F.col("a_h").alias("in_h"))
    to_hut = points.where("next IS NOT NULL").join(legs, F.col("next") == F.col("to_id")).select(*key, F.col("from_id").alias("cand"), F.col("duration_h").alias("out_h"))
    to_exit = points.where("next IS NULL").join(b, (F.col("exit_id") == F.col("b_point")) & (F.col("start_type") == F.col("b_type"))).select(*key, F.col("b_hut").alias("cand"), F.col("b_h").alias("out_h"))
    found = from_hut.unionByName(from_start).join(to_hut.unionByName(to_exit), [*key, "cand"])
    own = trips.select("trip_id", F.explode("huts").alias("cand")).distinct()
    return found.join(own, ["trip_id", "cand"], "left_anti").select("trip_id", "pos", F.col("cand").alias("hut_id"), "in_h", "out_h")


def extend_candidates(trips: DataFrame, adjacency: DataFrame, approaches: DataFrame, exits: DataFrame, variant: int, side: str = "last") -> DataFrame:
    """(trip_id, hut_id, leg_h): next huts at one end such that the longer trip can still be reached."""
    ends = trips.withColumn("end", F.element_at("huts", 1 if side == "first" else -1))
    found = ends.join(fastest_legs(adjacency), F.col("end") == F.col("from_id")).where(~F.array_contains("huts", F.col("to_id")))
    grown = F.concat(F.array("to_id"), "huts") if side == "first" else F.concat("huts", F.array("to_id"))
    found = found.select("trip_id", "start_type", "start_id", "exit_id", "to_id", "duration_h", grown.alias("huts")).withColumn("seq_id", F.struct("trip_id", "to_id"))
    ok = connected(found, approaches, exits, variant).select("seq_id")
    return found.join(ok, "seq_id", "left_semi").select("trip_id", F.col("to_id").alias("hut_id"), F.col("duration_h").alias("leg_h"))


def trim_checks(trips: DataFrame, adjacency: DataFrame, starts: DataFrame) -> DataFrame:
    """(trip_id, pos, ok, reason): may a stop be left out? starts: (start_id, start_type, huts, exits), a row a start: the huts that it leads to under any variant, and those with a way back under the variant asked for.

    An inner stop may go if its neighbours are linked, an end if the rest can still be reached. Only whether that is so counts, so no legs are listed: by car, each start gives its huts to the huts it has a way back from, where they meet the first huts that are asked for."""
    from routelake.plans.lineage import cut

    starts = cut(starts)
    n, pos = F.size("huts"), F.col("pos")
    each = trips.select("trip_id", n.alias("n"), F.posexplode("huts").alias("pos", "hut"), "huts")
    alone = each.where("n = 1").withColumn("reason", F.lit("last_hut"))
    middle = each.where((pos > 0) & (pos < F.col("n") - 1)).select("trip_id", "pos", F.get("huts", pos - 1).alias("prev"), F.get("huts", pos + 1).alias("next"))
    links = adjacency.select(F.col("from_id").alias("prev"), F.col("to_id").alias("next"), F.lit(True).alias("linked")).distinct()
    middle = middle.join(links, ["prev", "next"], "left").withColumn("reason", F.when(F.col("linked").isNull(), "no_link"))

    without = lambda at, first, last: F.struct(at.alias("pos"), F.get("huts", first).alias("first"), F.get("huts", last).alias("last"))
    ends = trips.where(n > 1).select("trip_id", "start_type", F.explode(F.array(without(F.lit(0), F.lit(1), n - 1), without(n - 1, F.lit(0), n - 2))).alias("e")).select("trip_id", "start_type", "e.*")
    by_car = mode_of(F.col("start_type")) == "car"
    cars = ends.where(by_car).select("trip_id", "pos", "first", "last", F.col("start_type").alias("kind"))
    asked = cars.groupBy("kind", "last").agg(F.collect_set("first").alias("asked"))
    given = starts.where(by_car).select(F.col("start_type").alias("kind"), F.explode("exits").alias("last"), F.col("huts").alias("given"))
    met = given.join(asked, ["kind", "last"]).select("kind", "last", F.explode(F.array_intersect("asked", "given")).alias("first"), F.lit(True).alias("reached")).distinct()
    cars = cars.join(met, ["kind", "first", "last"], "left")

    types = lambda huts, side: starts.where(~by_car).select("start_type", F.explode(huts).alias(side)).groupBy(side).agg(F.collect_set("start_type").alias(f"{side}_types"))
    # A row a hut each.
    others = ends.where(~by_car).join(F.broadcast(types("huts", "first")), "first", "left").join(F.broadcast(types("exits", "last")), "last", "left")
    others = others.withColumn("reached", F.when(F.array_contains("first_types", F.col("start_type")) & F.array_contains("last_types", F.col("start_type")), True))
    out = [alone, middle] + [x.withColumn("reason", F.when(F.col("reached").isNull(), "no_ends")) for x in (cars, others)]
    return reduce(DataFrame.unionByName, [x.select("trip_id", "pos", F.col("reason").isNull().alias("ok"), "reason") for x in out])


def endpoint_candidates(trips: DataFrame, approaches: DataFrame, exits: DataFrame, variant: int, which: str = "start") -> DataFrame:
    """(trip_id, point_id, duration_h): other starts or exits of the trip's type; by car only starts that are exits too, and no exits of their own."""
    a, b = _ends(approaches, variant, "a"), _ends(exits.where(F.col("variant") == variant), variant, "b")
    car = mode_of(F.col("start_type")) == "car"
    base = trips.where(F.size("huts") > 0).withColumns({"first": F.element_at("huts", 1), "last": F.element_at("huts", -1)})
    if which == "exit":
        return base.where(~car).join(b, (F.col("last") == F.col("b_hut")) & (F.col("start_type") == F.col("b_type"))).where("b_point != exit_id").select("trip_id", F.col("b_point").alias("point_id"), F.col("b_h").alias("duration_h"))
    found = base.join(a, (F.col("first") == F.col("a_hut")) & (F.col("start_type") == F.col("a_type"))).where("a_point != start_id")
    both = found.where(car).join(b, (F.col("last") == F.col("b_hut")) & (F.col("start_type") == F.col("b_type")) & (F.col("a_point") == F.col("b_point")), "left_semi")
    return found.where(~car).unionByName(both).select("trip_id", F.col("a_point").alias("point_id"), F.col("a_h").alias("duration_h"))


def trip_legs(trips: DataFrame, adjacency: DataFrame, approaches: DataFrame, exits: DataFrame, variant: int) -> DataFrame:
    """(trip_id, leg, kind, edge_id, reversed, duration_h): the legs from stop to stop, null where the graph has none."""
    best_a, best_b = best_start_legs(approaches, variant), best_start_legs(exits.where(F.col("variant") == variant), variant)
    first = trips.select("trip_id", F.lit(0).alias("leg"), F.lit("start").alias("kind"), F.col("start_type").alias("t"), F.col("start_id").alias("p"), F.element_at("huts", 1).alias("h"))
    last = trips.select("trip_id", F.size("huts").alias("leg"), F.lit("exit").alias("kind"), F.col("start_type").alias("t"), F.col("exit_id").alias("p"), F.element_at("huts", -1).alias("h"))
    shape = lambda df, legs: df.join(legs.select("hut_id", "start_id", "start_type", "edge_id", "reversed", "duration_h"), (F.col("h") == F.col("hut_id")) & (F.col("p") == F.col("start_id")) & (F.col("t") == F.col("start_type")), "left").select("trip_id", "leg", "kind", "edge_id", "reversed", "duration_h")
    pairs = F.arrays_zip(F.slice("huts", F.lit(1), F.size("huts") - 1).alias("a"), F.slice("huts", F.lit(2), F.greatest(F.size("huts") - 1, F.lit(0))).alias("b"))
    middle = trips.where(F.size("huts") > 1).select("trip_id", F.posexplode(pairs).alias("i", "x")).select("trip_id", (F.col("i") + 1).alias("leg"), F.lit("hut").alias("kind"), F.col("x.a").alias("from_id"), F.col("x.b").alias("to_id"))
    middle = middle.join(fastest_legs(adjacency), ["from_id", "to_id"], "left").select("trip_id", "leg", "kind", "edge_id", "reversed", "duration_h")
    return shape(first, best_a).unionByName(middle).unionByName(shape(last, best_b))


def changed_nights(legs: DataFrame) -> DataFrame:
    """(trip_id, night, changed): no leg arrives at the night's hut any more, or at the last one none leaves."""
    n = F.max("leg").over(Window.partitionBy("trip_id"))
    missing = F.col("edge_id").isNull()
    marked = legs.withColumns({"n": n, "next_missing": F.lead(missing).over(Window.partitionBy("trip_id").orderBy("leg"))})
    return marked.where("leg < n").select("trip_id", (F.col("leg") + 1).alias("night"), (missing | ((F.col("leg") == F.col("n") - 1) & F.col("next_missing"))).alias("changed"))


def totals(legs: DataFrame) -> DataFrame:
    """Sums over the legs that exist."""
    return legs.where("edge_id IS NOT NULL").groupBy("trip_id").agg(F.sum("duration_h").alias("duration_h"), F.count("*").alias("legs"))


def overlapping_legs(legs: DataFrame) -> DataFrame:
    """(trip_id, earlier, later): pairs of legs (trip_id, leg, n_legs, loop, ids, near_from, near_to) that walk the same segments. near_from and near_to run outward from where the leg departs and arrives; neighbours may share the run out of their hut, and on a loop the first and last the run out of the start."""
    a = legs.select("trip_id", F.col("leg").alias("earlier"), F.col("ids").alias("ids_a"), F.col("near_from").alias("from_a"), F.col("near_to").alias("to_a"))
    b = legs.select("trip_id", F.col("leg").alias("later"), "n_legs", "loop", F.col("ids").alias("ids_b"), F.col("near_from").alias("from_b"), F.col("near_to").alias("to_b"))
    pairs = a.join(b, "trip_id").where("earlier < later")
    none = F.expr("CAST(array() AS array<int>)")
    exempt = F.when(F.col("later") == F.col("earlier") + 1, common_run(F.col("to_a"), F.col("from_b"))).otherwise(none)
    home = F.when(F.col("loop") & (F.col("earlier") == 0) & (F.col("later") == F.col("n_legs") - 1), common_run(F.col("from_a"), F.col("to_b"))).otherwise(none)
    return pairs.where(overlaps(F.col("ids_b"), F.array_union(exempt, home), F.col("ids_a"))).select("trip_id", "earlier", "later")
