"""Times of legs and edges. Two models that never mix: seconds of an edge for routing, hours of a whole leg for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres an hour level, up and down (DIN 33466), and the speed model of edges.
LEVEL_MH, UP_MH, DOWN_MH = 4000.0, 300.0, 500.0
V0, K, S0, TECHNICAL_MS, LEAST_MS = 4.013, 3.5, 0.05, 0.2, 0.15


def leg_hours(distance: Column, ascent: Column, descent: Column) -> Column:
    level, steep = distance / LEVEL_MH, ascent / UP_MH + descent / DOWN_MH
    return F.greatest(level, steep) + F.least(level, steep) / 2


def speed_kmh(slope: Column, v0: float = V0, k: float = K, s0: float = S0) -> Column:
    return v0 * F.exp(-k * F.abs(slope + s0))


def edge_seconds(distance: Column, rise: Column, technical: Column | None = None) -> Column:
    """Seconds of an edge by its slope; technical ground is walked at one pace over its length in space; never below the least speed."""
    walked = F.when(distance > 0, distance / (speed_kmh(rise / distance) / 3.6)).otherwise(0.0)
    out = walked if technical is None else F.when(technical, F.hypot(distance, rise) / TECHNICAL_MS).otherwise(walked)
    return F.least(out, distance / LEAST_MS) if technical is None else F.when(technical, out).otherwise(F.least(out, distance / LEAST_MS))


def road_weight(seconds: Column, multiplier: float, road_share: Column) -> Column:
    return seconds * (1 + (multiplier - 1) * road_share)
