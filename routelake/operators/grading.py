"""Grades of ways, variants of edges, classes of huts and start points."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.schema import VARIANTS, variant_passes

#: Fixed values of the tag scheme.
SAC_RANK = {"strolling": 0, "hiking": 1, "mountain_hiking": 2, "demanding_mountain_hiking": 3, "alpine_hiking": 4, "demanding_alpine_hiking": 5, "difficult_alpine_hiking": 6}
IMPLIED_RANK = {"residential": 1, "service": 1, "unclassified": 1, "tertiary": 1, "track": 1, "footway": 1, "steps": 2}
PAVED = ("asphalt", "paving_stones", "concrete")
BAD_VISIBILITY = ("bad", "horrible", "no")
FOOT_ALLOWED = ("yes", "permissive", "designated")
ROADS = ("residential", "service", "unclassified", "tertiary")
TRAILS = ("path", "footway", "track", "steps", "residential", "service", "unclassified", "tertiary", "via_ferrata")
UNKNOWN = -1


def _is(tag: str, *values: str) -> Column:
    return F.coalesce(F.col(tag).isin(*values), F.lit(False))


def _rank(table: dict[str, int], tag: str) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), F.coalesce(tag, F.lit("")))


def impassable() -> Column:
    return _is("access", "no") & ~_is("foot", *FOOT_ALLOWED)


def downgraded() -> Column:
    return _is("trail_visibility", *BAD_VISIBILITY) | _is("informal", "yes") | _is("ladder", "yes") | _is("access", "private", "no")


def graded(ways: DataFrame) -> DataFrame:
    """Adds sac_rank and tier: explicit, else inferred from the kind of way, else ungraded and -1."""
    explicit, implied = _rank(SAC_RANK, "sac_scale"), _rank(IMPLIED_RANK, "highway")
    paved = _is("highway", "path") & _is("surface", *PAVED)
    inferred = F.coalesce(implied, F.when(paved, 1))
    return ways.withColumns({
        "sac_rank": F.coalesce(explicit, inferred, F.lit(UNKNOWN)).cast("int"),
        "tier": F.when(explicit.isNotNull(), "explicit").when(inferred.isNotNull(), "inferred").otherwise("ungraded"),
    })


def passable_graded(ways: DataFrame) -> DataFrame:
    """Passable ways with sac_rank, tier, road, via_ferrata, downgraded and constrained_ok."""
    out = graded(ways.where(~impassable()))
    out = out.withColumns({"road": _is("highway", *ROADS), "via_ferrata": _is("highway", "via_ferrata"), "downgraded": downgraded()})
    return out.withColumn("constrained_ok", (F.col("sac_rank") >= 0) & ~F.col("via_ferrata") & ~F.col("downgraded"))


def exclusion_reasons(ways: DataFrame) -> DataFrame:
    """Adds reasons: why a way is left out of constrained variants, in a fixed order."""
    tests = {"visibility": _is("trail_visibility", *BAD_VISIBILITY), "informal": _is("informal", "yes"), "ladder": _is("ladder", "yes"), "access": _is("access", "private", "no"), "foot": _is("foot", "no")}
    return ways.withColumn("reasons", F.filter(F.array(*[F.when(t, name) for name, t in tests.items()]), lambda x: x.isNotNull()))


def tier_mass(ways: DataFrame) -> DataFrame:
    """Length and number of ways by (tier, sac_rank), by tier, and of all, in one pass over the data."""
    return graded(ways).rollup("tier", "sac_rank").agg(F.sum("length_m").alias("length_m"), F.count("*").alias("ways"))


def by_variant(edges: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Each edge once for every variant it may be used under; ord is the place of the variant among names."""
    chosen = VARIANTS if not names else [v for n in names for v in VARIANTS if v[1] == n]
    rows = [F.struct(F.lit(v[0]).alias("variant"), F.lit(v[1]).alias("variant_name"), F.lit(v[2]).cast("int").alias("max_sac_rank"), F.lit(v[3]).alias("require_graded"), F.lit(v[4]).alias("allow_ungraded"), F.lit(i).alias("ord")) for i, v in enumerate(chosen)]
    return edges.select("*", F.explode(F.array(*rows)).alias("v_")).select(*edges.columns, "v_.*").where(variant_passes())


def segments(ways: DataFrame) -> DataFrame:
    """(way_id, pos, from, to) of consecutive nodes of ways (way_id, nodes array<struct<ref, lon, lat>>); nodes without place are left out, and ways with fewer than two."""
    valid = F.filter("nodes", lambda n: n["lon"].isNotNull() & n["lat"].isNotNull())
    kept = ways.withColumn("nodes", valid).where(F.size("nodes") >= 2)
    pairs = F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("a"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("b"))
    return kept.select("way_id", F.posexplode(pairs).alias("pos", "pair"), *[c for c in kept.columns if c not in ("way_id", "nodes")]).select("way_id", "pos", F.col("pair.a").alias("from"), F.col("pair.b").alias("to"), *[c for c in kept.columns if c not in ("way_id", "nodes")])


def hut_class(category: Column, club: Column) -> tuple[Column, Column]:
    """(type, serviced) by category and club number; the order of the tests counts."""
    hut, partner = club.isin(8, 5, 3), club.isin(19, 9, 17, 16)
    kind = F.when(category.isin(20, 60), F.when(hut, "av").otherwise("sonstige")).when(hut, "av").when(partner, "partner").otherwise("sonstige")
    serviced = F.when(category.isin(20, 60), False).when(hut, True).when(partner, None).otherwise(True)
    return kind, serviced


def usable_start() -> Column:
    """Whether a start point can be reached by the public."""
    return ~(_is("access", "private", "no") | _is("motor_vehicle", "private", "no") | _is("barrier", "gate", "lift_gate") | _is("disused", "yes") | _is("abandoned", "yes"))


def operator_of(club: Column) -> Column:
    return F.when(club == 8, "OEAV").when(club == 5, "DAV").otherwise("other")


def region_of(lon: Column) -> Column:
    return F.when(lon < 10.5, "west").when(lon < 12.5, "central").otherwise("east")


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    return rows.withColumn("first_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("first_ = 1").drop("first_")
