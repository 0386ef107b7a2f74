"""Codes and the difficulty variants that queries of a hiking network use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of hubs.
HUT, STATION, PARKING, PARTNER = 0, 1, 2, 3
#: Modes of travel and the type of start that each asks for.
MODE_SOURCE = {"transit": STATION, "car": PARKING, "village": PARTNER, "any": None}
#: Variant code, name, highest grade, whether grades are asked for, whether unknown grades pass.
VARIANTS = (
    (0, "FAST_ANY", None, False, False),
    (1, "FAST_T2", 2, True, False),
    (2, "FAST_T3", 3, True, False),
    (3, "FAST_T3_UNGRADED", 3, True, True),
)
FAST_ANY, FAST_T2, FAST_T3, FAST_T3_UNGRADED = range(4)


def variants(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The variant dimension; with names, those in the given order (column ord)."""
    rows = [(*v, names.index(v[1]) if names else v[0]) for v in VARIANTS if not names or v[1] in names]
    return spark.createDataFrame(rows, "variant int, variant_name string, max_sac_rank int, require_graded boolean, allow_ungraded boolean, ord int").orderBy("ord")


def resolve_variant(sac_ceiling: int | None, allow_ungraded: bool, names: list[str]) -> int | None:
    """The variant that a difficulty ceiling asks for, None if the data don't have it."""
    if sac_ceiling is not None and sac_ceiling <= 2:
        wanted = "FAST_T2"
    elif sac_ceiling is not None and sac_ceiling <= 3:
        wanted = "FAST_T3_UNGRADED" if allow_ungraded else "FAST_T3"
    else:
        wanted = "FAST_ANY"
    known = {v[1]: v[0] for v in VARIANTS}
    return known[wanted] if wanted in names else None


def variant_passes() -> F.Column:
    """Whether an edge (sac_rank, via_ferrata, downgraded, constrained_ok) may be used under a variant row beside it. An unknown grade, -1, is under no ceiling."""
    known_ok = F.col("constrained_ok") & (F.col("sac_rank") >= 0) & (F.col("sac_rank") <= F.col("max_sac_rank"))
    unknown_ok = ~F.col("via_ferrata") & ~F.col("downgraded") & (F.col("sac_rank") <= F.col("max_sac_rank"))
    return F.when(~F.col("require_graded"), True).when(F.col("allow_ungraded"), unknown_ok).otherwise(known_ok)
