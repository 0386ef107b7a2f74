"""The booking study: hut days, seasons, bottlenecks of tours, controls and the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.geo import haversine_m

#: Fixed values of the study.
LEAST_OPEN_DAYS, NEARLY, LEAST_HUTS, RATIO, CONTROLS, ELE_TOL_M, SIZE_TOL_SD, MOST_NIGHTS, PLACEBO_LOG_TOL = 14, 0.05, 3, 0.7, 3, 500.0, 1.0, 2, 0.2


def day_facts(days: DataFrame) -> DataFrame:
    """hut days (ohrs_id, d, status, free_place, capacity) with open, occupancy (null when closed) and sold-out marks."""
    free = F.least(F.greatest("free_place", F.lit(0)), "capacity")
    return days.withColumns({
        "open": F.col("status") == "SERVICED", "free_above_capacity": F.col("free_place") > F.col("capacity"),
        "sold_out": F.col("free_place") <= 0, "sold_out_near": F.col("free_place") <= NEARLY * F.col("capacity"),
    }).withColumn("occupancy", F.when(F.col("open"), (F.col("capacity") - free) / F.col("capacity")))


def in_cut(cut: str, day: Column) -> Column:
    return {"season": F.lit(True), "jul_aug": F.month(day).isin(7, 8), "fri_sun": F.weekday(day) >= 4}[cut]


def seasons(facts: DataFrame, cut: str = "season") -> DataFrame:
    """One row a hut and season (the year): eligibility and flags over all open days, outcomes over the cut."""
    op, sub = F.col("open"), F.col("open") & in_cut(cut, F.col("d"))
    n = F.count_if(sub)
    share = lambda c: F.try_divide(F.count_if(sub & F.col(c)), n)
    value = F.when(op, F.col("free_place"))
    return facts.groupBy("ohrs_id", F.year("d").alias("season")).agg(
        F.count_if(op).alias("open_days"), (F.count_if(op) >= LEAST_OPEN_DAYS).alias("eligible"),
        F.coalesce((F.min(value) == F.max(value)) & (F.max(value) != 0), F.lit(False)).alias("no_activity"),
        F.coalesce(F.bool_or(op & F.col("free_above_capacity")), F.lit(False)).alias("capacity_mismatch"), n.alias("cut_open_days"),
        F.avg(F.when(sub, F.col("occupancy"))).alias("occupancy"), F.count_if(sub & F.col("sold_out")).alias("sold_out_days"), share("sold_out").alias("sold_out_share"),
        F.count_if(sub & F.col("sold_out_near")).alias("sold_out_near_days"), share("sold_out_near").alias("sold_out_near_share"),
    )


def selected(table: DataFrame, relax: tuple[str, ...] = ()) -> DataFrame:
    """Eligible huts with activity and without mismatch; each condition can be relaxed by name."""
    tests = {"eligible": F.col("eligible"), "no_activity": ~F.col("no_activity"), "capacity_mismatch": ~F.col("capacity_mismatch")}
    for name, test in tests.items():
        if name not in relax:
            table = table.where(test)
    return table


def coverage(table: DataFrame) -> DataFrame:
    """Share of eligible and inactive huts by season and group."""
    return table.groupBy("season", "tour").agg(F.count("*").alias("huts"), F.avg(F.col("eligible").cast("int")).alias("eligible_share"), F.avg(F.col("no_activity").cast("int")).alias("no_activity_share"))


def consistency(old: DataFrame, new: DataFrame) -> DataFrame:
    """(days, differing): days that both calendars have, and those whose free places differ by more than one."""
    joined = old.select("ohrs_id", "d", F.col("free_place").alias("a")).join(new.select("ohrs_id", "d", F.col("free_place").alias("b")), ["ohrs_id", "d"])
    return joined.agg(F.count("*").alias("days"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1).alias("differing"))


def shifted(series: DataFrame, k: int, name: str = "v") -> DataFrame:
    """(ohrs_id, d, shifted): the value k calendar days before, null where that day is missing."""
    before = series.select("ohrs_id", F.date_add("d", k).alias("d"), F.col(name).alias("shifted"))
    return series.select("ohrs_id", "d").join(before, ["ohrs_id", "d"], "left")


def full_series(facts: DataFrame, column: str = "sold_out") -> DataFrame:
    """(ohrs_id, d, v): 1 on sold-out open days, 0 on other open days, null when closed."""
    return facts.select("ohrs_id", "d", F.when(F.col("open"), F.col(column).cast("double")).alias("v"))


def aligned(series: DataFrame, m: int) -> DataFrame:
    """(ohrs_id, d, treat): the greater of the values m days before and after, null unless both are known."""
    a, b = shifted(series, m).withColumnRenamed("shifted", "a"), shifted(series, -m).withColumnRenamed("shifted", "b")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, ["ohrs_id", "d"]).select("ohrs_id", "d", F.when(both, F.greatest("a", "b")).alias("treat"))


def shuffled(series: DataFrame, seed: int) -> DataFrame:
    """The known values of each hut, month and weekday in another order, by a seeded hash."""
    known = series.where("v IS NOT NULL").withColumns({"m_": F.month("d"), "w_": F.weekday("d")})
    key = Window.partitionBy("ohrs_id", "m_", "w_")
    places = known.withColumn("i", F.row_number().over(key.orderBy("d"))).drop("v")
    values = known.withColumn("i", F.row_number().over(key.orderBy(F.xxhash64(F.lit(seed), "ohrs_id", "d"), "d"))).select("ohrs_id", "m_", "w_", "i", "v")
    moved = places.join(values, ["ohrs_id", "m_", "w_", "i"]).select("ohrs_id", "d", "v")
    return series.select("ohrs_id", "d").join(moved, ["ohrs_id", "d"], "left")


def stage_distance(i: Column, j: Column, n: Column, circular: Column) -> Column:
    d = F.abs(i - j)
    return F.when(circular, F.least(d, n - d)).otherwise(d)


def positions(tours: DataFrame) -> DataFrame:
    """(tour, circular, n, hut, pos): first place of each hut in tours (tour, circular, huts)."""
    each = tours.select("tour", "circular", F.size("huts").alias("n"), F.posexplode("huts").alias("pos", "hut")).where("hut IS NOT NULL")
    return each.groupBy("tour", "circular", "n", "hut").agg(F.min("pos").alias("pos"))


def collapsed(legs: DataFrame) -> DataFrame:
    """(tour, seq): huts of legs (tour, ord, hut) in order, neighbours that repeat taken once."""
    line = Window.partitionBy("tour").orderBy("ord")
    new = legs.withColumn("before", F.lag("hut").over(line)).where("before IS NULL OR before != hut")
    return new.groupBy("tour").agg(F.array_sort(F.collect_list(F.struct("ord", "hut"))).alias("s")).select("tour", F.col("s.hut").alias("seq"))


def order_agreement(pairs: DataFrame) -> DataFrame:
    """Adds verdict, shared, a_only and b_only to pairs with hut lists a and b."""
    a = F.filter("a", lambda x: F.array_contains("b", x))
    b = F.filter("b", lambda x: F.array_contains("a", x))
    verdict = F.when(F.size(a) < LEAST_HUTS, "too_few_shared").when(a == b, "same").when(a == F.reverse(b), "reversed").otherwise("disagree")
    return pairs.withColumns({"verdict": verdict, "shared": F.size(a), "a_only": F.array_except("a", "b"), "b_only": F.array_except("b", "a")})


def matched_names(official: DataFrame, known: DataFrame) -> DataFrame:
    """(known_name, name): the one official tour whose plain name starts with the known one's; none or several give null. Names meet by their first letters."""
    from routelake.functions.text import normalised

    a = official.withColumn("plain", normalised(F.col("name"))).withColumn("head", F.substring("plain", 1, 3))
    b = known.withColumn("known_plain", normalised(F.col("known_name"))).withColumn("head", F.substring("known_plain", 1, 3))
    found = b.join(a, "head").where(F.startswith("plain", "known_plain")).groupBy("known_name").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    return known.join(found, "known_name", "left").select("known_name", F.when(F.col("n") == 1, F.col("name")).alias("name"))


def candidates(tours: DataFrame, table: DataFrame) -> DataFrame:
    """Per tour (tour, huts) the eligible hut of least capacity, of equals the most often sold out, and whether it is a bottleneck."""
    each = tours.select("tour", F.size("huts").alias("n_huts"), F.explode_outer(F.array_distinct("huts")).alias("ohrs_id"))
    joined = each.join(table.select("ohrs_id", "capacity", "sold_out_share"), "ohrs_id", "left")
    best = F.min_by("ohrs_id", F.when(F.col("capacity").isNotNull(), F.struct(F.col("capacity"), (-F.coalesce("sold_out_share", F.lit(-1.0))).alias("s"), F.col("ohrs_id"))))
    grouped = joined.groupBy("tour", "n_huts").agg(F.count("capacity").alias("n_eligible"), best.alias("bottleneck"), F.min("capacity").cast("double").alias("capacity"), F.median("capacity").alias("median_capacity"))
    enough = F.col("n_eligible") >= LEAST_HUTS
    keep = [F.when(enough, F.col(c)).alias(c) for c in ("bottleneck", "capacity", "median_capacity")]
    ratio = F.when(enough, F.col("capacity") / F.col("median_capacity"))
    return grouped.select("tour", "n_huts", "n_eligible", *keep, ratio.alias("ratio"), F.coalesce(ratio <= RATIO, F.lit(False)).alias("qualifies"))


def controls(huts: DataFrame, pool: DataFrame, log_sd: float, k: int = CONTROLS, most_km: float | None = None) -> DataFrame:
    """(b, hut, km, rank): for huts (b, elevation, capacity, lon, lat) the k nearest of the pool within the tolerances of height and size. Heights meet in bands as wide as the tolerance."""
    band = lambda c: F.floor(F.col(c) / ELE_TOL_M)
    left = huts.withColumn("band", F.explode(F.sequence(band("elevation") - 1, band("elevation") + 1)))
    right = pool.select(F.col("ohrs_id").alias("hut"), F.col("elevation").alias("ele2"), F.col("capacity").alias("cap2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).withColumn("band", band("ele2"))
    near = (F.abs(F.col("ele2") - F.col("elevation")) <= ELE_TOL_M) & (F.abs(F.log("cap2") - F.log("capacity")) / log_sd <= SIZE_TOL_SD)
    found = left.join(right, "band").where(near).withColumn("km", haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) / 1000)
    if most_km is not None:
        found = found.where(F.col("km") <= most_km)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("km", "hut"))).where(F.col("rank") <= k).select("b", "hut", "km", "rank")


def units(bottlenecks: DataFrame, tours: DataFrame, table: DataFrame, log_sd: float, most_km: float | None = None) -> DataFrame:
    """(tour, a, b, m, controls): tour huts b within two nights of the bottleneck a that have a control."""
    places = positions(tours)
    ref = bottlenecks.join(places, (bottlenecks.tour == places.tour) & (bottlenecks.a == places.hut)).select(bottlenecks.tour.alias("tour"), "a", F.col("pos").alias("pos_a"))
    near = ref.join(places, "tour").where("hut != a").withColumn("m", stage_distance(F.col("pos_a"), F.col("pos"), F.col("n"), F.col("circular"))).where(F.col("m").between(1, MOST_NIGHTS))
    b = near.select("tour", "a", F.col("hut").alias("b"), "m").join(table.select(F.col("ohrs_id").alias("b"), "elevation", "capacity", "lon", "lat"), "b")
    chosen = controls(b.select("b", "elevation", "capacity", "lon", "lat").distinct(), table.where("tour = 0"), log_sd, CONTROLS + 1, most_km)
    # The bottleneck itself is never a control; one more than needed was asked for in its place.
    each = b.join(chosen, "b").where("hut != a").withColumn("nth", F.row_number().over(Window.partitionBy("tour", "a", "b").orderBy("km", "hut"))).where(F.col("nth") <= CONTROLS)
    return each.groupBy("tour", "a", "b", "m").agg(F.array_sort(F.collect_list(F.struct("km", "hut"))).alias("controls"))


def panel(units_: DataFrame, facts: DataFrame, treatment: DataFrame) -> DataFrame:
    """(tour, a, b, m, hut, tour_hut, d, y, treat, x): days of each unit's hut and controls with known occupancy and treatment (a, m, d, treat)."""
    each = units_.select("tour", "a", "b", "m", F.explode(F.concat(F.array(F.struct(F.col("b").alias("hut"), F.lit(1).alias("tour_hut"))), F.transform("controls", lambda c: F.struct(c["hut"].alias("hut"), F.lit(0).alias("tour_hut"))))).alias("h")).select("tour", "a", "b", "m", "h.*")
    days = facts.select(F.col("ohrs_id").alias("hut"), "d", F.col("occupancy").alias("y"), "sold_out").where("y IS NOT NULL")
    out = each.join(days, "hut").join(treatment.where("treat IS NOT NULL"), ["a", "m", "d"])
    return out.withColumn("x", F.col("tour_hut") * F.col("treat"))


def placebo(a: DataFrame, pool: DataFrame) -> DataFrame:
    """(a, placebo): the nearest hut of the pool of nearly the same capacity."""
    left = a.withColumn("band", F.explode(F.sequence(F.floor(F.log("capacity") / PLACEBO_LOG_TOL) - 1, F.floor(F.log("capacity") / PLACEBO_LOG_TOL) + 1)))
    right = pool.select(F.col("ohrs_id").alias("hut"), F.col("capacity").alias("cap2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).withColumn("band", F.floor(F.log("cap2") / PLACEBO_LOG_TOL))
    found = left.join(right, "band").where(F.abs(F.log("cap2") - F.log("capacity")) <= PLACEBO_LOG_TOL)
    return found.groupBy("a").agg(F.min_by("hut", F.struct(haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("m"), "hut")).alias("placebo"))


def matched(rows: DataFrame, outcome: str, variables: list[str], k: int = 3) -> DataFrame:
    """(id, diff, n): treated rows (id, treated, grp) against the mean of their k nearest untreated ones of the same group, by standardised variables."""
    spread = lambda v: F.coalesce(F.nullif(F.stddev_pop(v), F.lit(0.0)), F.lit(1.0))
    scale = rows.agg(*[f(v).alias(f"{n}{i}_") for i, v in enumerate(variables) for n, f in (("mean", F.avg), ("sd", spread))])
    z = {f"z{i}": (F.col(v) - F.col(f"mean{i}_")) / F.col(f"sd{i}_") for i, v in enumerate(variables)}
    scored = rows.join(F.broadcast(scale)).withColumns(z)  # one row of means and spreads
    a = scored.where("treated = 1").select("id", "grp", F.col(outcome).alias("out_a"), *[F.col(c).alias(f"{c}a") for c in z])
    b = scored.where("treated = 0").select(F.col("id").alias("other"), "grp", F.col(outcome).alias("out_b"), *[F.col(c).alias(f"{c}b") for c in z])
    d2 = sum((F.pow(F.col(f"{c}a") - F.col(f"{c}b"), F.lit(2)) for c in z), F.lit(0.0))
    near = a.join(b, "grp").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(d2, "other"))).where(F.col("rank") <= k)
    return near.groupBy("id").agg((F.first("out_a") - F.avg("out_b")).alias("diff"), F.count("*").alias("n"))


def linked(features: DataFrame, info: DataFrame, tour_guids: DataFrame, minutes: DataFrame, calendars: DataFrame) -> DataFrame:
    """Hut master by booking number: features (ohrs_id, guid, name, serviced, elevation, club, lon, lat), info (ohrs_id, capacity), tour_guids (guid), minutes (guid, minutes), calendars (ohrs_id). error says why a hut is left out."""
    from routelake.operators.grading import operator_of, region_of

    on_tour = tour_guids.select(F.upper("guid").alias("guid_")).distinct().withColumn("hit", F.lit(True))
    times = minutes.select(F.upper("guid").alias("guid_"), "minutes").groupBy("guid_").agg(F.min("minutes").alias("minutes"))
    rows = features.where("ohrs_id IS NOT NULL").withColumn("guid_", F.upper("guid")).join(on_tour, "guid_", "left").join(times, "guid_", "left")
    first = F.min(F.struct("guid", "elevation", "club"))
    huts = rows.groupBy("ohrs_id").agg(F.array_sort(F.collect_list("guid")).alias("guids"), F.array_sort(F.collect_list("name")).alias("names"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("on_tour"), F.coalesce(F.bool_or("serviced"), F.lit(False)).alias("serviced"), first.alias("f"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min("minutes").alias("approach_time_min"))
    known = calendars.select("ohrs_id").distinct().withColumn("calendar", F.lit(True))
    huts = huts.join(info, "ohrs_id", "left").join(known, "ohrs_id", "left")
    error = F.when(~F.col("serviced"), "self_service").when(F.col("capacity").isNull() | (F.col("capacity") <= 0), "no_capacity").when(F.col("calendar").isNull(), "no_calendar")
    return huts.select("ohrs_id", "guids", "names", "on_tour", F.col("f.elevation").alias("elevation"), operator_of(F.col("f.club")).alias("operator"), region_of(F.col("lon")).alias("region"), "capacity", "lon", "lat", "approach_time_min", error.alias("error"))


def unmatched_guids(tour_guids: DataFrame, features: DataFrame) -> DataFrame:
    return tour_guids.select(F.upper("guid").alias("guid")).distinct().join(features.select(F.upper("guid").alias("guid")), "guid", "left_anti")


def offset_treatments(series: DataFrame, offsets: tuple[int, ...] = (-3, -2, -1, 0, 1, 2, 3)) -> DataFrame:
    """(k, ohrs_id, d, treat): the series at each signed offset."""
    out = None
    for k in offsets:
        part = shifted(series, k).withColumnRenamed("shifted", "treat").withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def rank_share(effects: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tours, observed, chance): how often the chosen hut (tour, a) has the most negative effect (tour, a, effect) of its tour's, and how often it would by chance; tours need two effects or more."""
    best = effects.groupBy("tour").agg(F.min_by("a", F.struct("effect", "a")).alias("best"), F.count("*").alias("n"), F.collect_set("a").alias("fitted"))
    usable = best.join(chosen.withColumnRenamed("a", "chosen"), "tour").where((F.col("n") >= 2) & F.array_contains("fitted", F.col("chosen")))
    return usable.agg(F.count("*").alias("tours"), F.avg((F.col("best") == F.col("chosen")).cast("double")).alias("observed"), F.avg(1 / F.col("n")).alias("chance"))


def control_distances(units_: DataFrame) -> DataFrame:
    """(n, median, max) of the kilometres to all chosen controls."""
    km = units_.select(F.explode("controls").alias("c")).select(F.col("c.km").alias("km"))
    return km.agg(F.count("*").alias("n"), F.median("km").alias("median"), F.max("km").alias("max"))


#: Outcomes of the study, the column of each, and which condition each variant of the selection relaxes.
OUTCOMES = {"occupancy": "occupancy", "sold_out": "sold_out_share", "sold_out_near": "sold_out_near_share"}
VARIANTS = {"primary": (), "incl_no_activity": ("no_activity",), "incl_mismatch": ("capacity_mismatch",)}
LEAST_GROUP = 5


def specification_rows(facts: DataFrame, on_tour: DataFrame, cuts: tuple[str, ...] = ("season", "jul_aug", "fri_sun")) -> DataFrame:
    """(spec, season, cut, outcome, variant, ohrs_id, tour, value): all that the specifications compare; on_tour has (ohrs_id, tour 0 or 1). One pass over the days a cut."""
    out = None
    for cut in cuts:
        table = seasons(facts, cut).join(on_tour, "ohrs_id")
        for variant, relax in VARIANTS.items():
            each = selected(table, relax).select("season", "ohrs_id", "tour", F.explode(F.create_map(*[x for name, c in OUTCOMES.items() for x in (F.lit(name), F.col(c))])).alias("outcome", "value"))
            part = each.where("value IS NOT NULL").withColumns({"cut": F.lit(cut), "variant": F.lit(variant)})
            out = part if out is None else out.unionByName(part)
    return out.withColumn("spec", F.concat_ws("|", "season", "cut", "outcome", "variant"))


def specifications(rows: DataFrame) -> DataFrame:
    """(spec, n_tour, n_other, mean_tour, mean_other, sd, mde, skipped) of specification_rows(); a group below LEAST_GROUP is skipped."""
    from routelake.operators.stats import least_detectable

    side = lambda f, t: f(F.when(F.col("tour") == t, F.col("value")))
    out = rows.groupBy("spec").agg(side(F.count, 1).alias("n_tour"), side(F.count, 0).alias("n_other"), side(F.avg, 1).alias("mean_tour"), side(F.avg, 0).alias("mean_other"), F.stddev_samp("value").alias("sd"))
    small = F.least("n_tour", "n_other") < LEAST_GROUP
    reason = F.format_string("group too small (%d tour / %d other)", "n_tour", "n_other")
    out = out.withColumn("mde", F.when(~small, least_detectable(F.col("n_tour"), F.col("n_other"), F.col("sd"))))
    return out.withColumns({c: F.when(~small, F.col(c)) for c in ("mean_tour", "mean_other", "sd")} | {"skipped": F.when(small, reason)})
