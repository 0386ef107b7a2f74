"""Geometry as column expressions: distances, grids, anchors, points on lines and in polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius and the metres of a degree of latitude.
EARTH_M, DEGREE_M = 6_371_000.0, 111_320.0
ANCHOR_STEP = 1e-4
POINT_STEP = 1e-7


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    root = F.sqrt(a)
    # Not least(), which would turn an unknown point into the longest distance.
    return 2 * EARTH_M * F.asin(F.when(root > 1, 1.0).otherwise(root))


def rounded(x: Column, digits: int) -> Column:
    """A value of at least zero to so many digits, half up: a product, a floor and a quotient, as round() goes by way of text."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Local plane coordinates around (lon0, lat0)."""
    return (lon - lon0) * DEGREE_M * F.cos(F.radians(lat0)), (lat - lat0) * DEGREE_M


def grid_cell(lon: Column, lat: Column, lon0: float, lat0: float, lon1: float, lat1: float, tile_km: float) -> Column:
    """Row-major number of the tile that holds a point; points outside fall in the border tiles."""
    step_lat, columns, rows = grid_shape(lon0, lat0, lon1, lat1, tile_km)
    step_lon = step_lat / _cosine((lat0 + lat1) / 2)
    col = F.least(F.greatest(F.floor((lon - lon0) / step_lon), F.lit(0)), F.lit(columns - 1))
    row = F.least(F.greatest(F.floor((lat - lat0) / step_lat), F.lit(0)), F.lit(rows - 1))
    return (row * columns + col).cast("long")


def _cosine(degrees: float) -> float:
    import math

    return math.cos(math.radians(degrees))


def grid_shape(lon0: float, lat0: float, lon1: float, lat1: float, tile_km: float) -> tuple[float, int, int]:
    """(degrees of latitude, columns, rows) of the tiles of a box."""
    import math

    step = tile_km * 1000 / DEGREE_M
    return step, max(1, math.ceil((lon1 - lon0) * _cosine((lat0 + lat1) / 2) / step)), max(1, math.ceil((lat1 - lat0) / step))


def cell_bounds(cell: Column, lon0: float, lat0: float, lon1: float, lat1: float, tile_km: float, pad_km: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a tile, widened on all sides."""
    step_lat, columns, _ = grid_shape(lon0, lat0, lon1, lat1, tile_km)
    step_lon, pad = step_lat / _cosine((lat0 + lat1) / 2), pad_km / tile_km
    col, row = F.pmod(cell, F.lit(columns)), F.floor(cell / columns)
    return lon0 + (col - pad) * step_lon, lat0 + (row - pad) * step_lat, lon0 + (col + 1 + pad) * step_lon, lat0 + (row + 1 + pad) * step_lat


def cells_over(west: Column, south: Column, east: Column, north: Column, lon0: float, lat0: float, lon1: float, lat1: float, tile_km: float) -> Column:
    """Numbers of the tiles that a box meets, row by row."""
    _, columns, _ = grid_shape(lon0, lat0, lon1, lat1, tile_km)
    low, high = (grid_cell(x, y, lon0, lat0, lon1, lat1, tile_km) for x, y in ((west, south), (east, north)))
    wide = F.pmod(high, F.lit(columns)) - F.pmod(low, F.lit(columns))
    rows = F.sequence(F.lit(0).cast("long"), F.floor(high / columns) - F.floor(low / columns))
    return F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0).cast("long"), wide), lambda c: low + r * columns + c)))


def circle_ring(lon: Column, lat: Column, radius_km: float, n: int = 32) -> Column:
    """A closed ring of so many points around a place, from north by east."""
    step_lat = radius_km * 1000 / DEGREE_M
    turn = lambda k: 2 * F.pi() * k / n
    point = lambda k: F.struct((lon + step_lat * F.sin(turn(k)) / F.cos(F.radians(lat))).alias("lon"), (lat + step_lat * F.cos(turn(k))).alias("lat"))
    return F.transform(F.concat(F.sequence(F.lit(0), F.lit(n - 1)), F.array(F.lit(0))), point)


def point_code(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Exact keys of a point at 1e-7 degrees, half to even."""
    return F.rint(lon / POINT_STEP).cast("long"), F.rint(lat / POINT_STEP).cast("long")


def quantised_offset(value: Column, reference: Column) -> Column:
    """Offset from a reference in steps of 1e-4 degrees as a 16-bit number; beyond its range is an error."""
    steps = F.rint((value - reference) / ANCHOR_STEP)
    return F.when((steps >= -32768) & (steps <= 32767), steps.cast("smallint")).otherwise(F.raise_error(F.lit("offset beyond 16 bits")).cast("smallint"))


def decoded_offset(offset: Column, reference: Column) -> Column:
    return reference + offset * ANCHOR_STEP


def nearest_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(fraction along the segment, squared distance) of the nearest point, all in one plane."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / long2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    qx, qy = ax + t * dx - px, ay + t * dy - py
    return t, qx * qx + qy * qy


def ring_crossed(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the ray to the east from a point crosses a polygon's edge; an odd number of crossings means inside, holes included."""
    return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def straightness(lon1: Column, lat1: Column, lon2: Column, lat2: Column, length_m: Column) -> Column:
    return F.try_divide(haversine_m(lon1, lat1, lon2, lat2), length_m)


def mercator_tile(lon: Column, lat: Column, zoom: Column, pixels: int = 60) -> tuple[Column, Column]:
    """Grid of so many pixels of a web map at a zoom."""
    world = 256 * F.pow(F.lit(2.0), zoom)
    x = (lon + 180) / 360 * world
    s = F.sin(F.radians(lat))
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * world
    return F.floor(x / pixels), F.floor(y / pixels)
