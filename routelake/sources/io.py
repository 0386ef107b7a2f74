"""Sources and sinks: GeoJSON, polygons, packed columns, trips as JSON and links, incremental caches."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelake.functions.text import from_share_code, number_of_feature, share_code

FEATURES = "type string, features array<struct<type: string, id: string, geometry: struct<type: string, coordinates: array<double>>, properties: map<string, string>>>"
TRIP = "v int, t struct<start_type: int, start_id: bigint, exit_id: bigint, huts: array<bigint>, date: string, party: int>"
PREFIX = "#trip="
MOST_PARTY = 25
#: Names of number types in a manifest of packed columns.
DTYPES = {"i1": "<i1", "u1": "<u1", "i2": "<i2", "u2": "<u2", "i4": "<i4", "u4": "<u4", "f4": "<f4", "f8": "<f8"}


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, osm_id, name, lon, lat, properties) of a GeoJSON file of points; features without place are left out."""
    each = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    point = each.where("f.geometry.type = 'Point' AND size(f.geometry.coordinates) >= 2")
    feature = F.coalesce("f.id", F.col("f.properties")["id"])
    return point.select(feature.alias("feature_id"), number_of_feature(feature).alias("osm_id"), F.col("f.properties")["name"].alias("name"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.properties").alias("properties"))


def feature_rows(points: DataFrame, properties: list[str]) -> DataFrame:
    """(value): a GeoJSON feature a row, for text sinks of one feature a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def hubs(*layers: DataFrame) -> DataFrame:
    """Union of hub layers (hub_type, hub_id, …); of one key the row of the last layer stays."""
    parts = [layer.withColumn("layer_", F.lit(i)) for i, layer in enumerate(layers)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("hub_type", "hub_id", "layer_")]
    return out.groupBy("hub_type", "hub_id").agg(F.max_by(F.struct(*rest), "layer_").alias("r")).select("hub_type", "hub_id", "r.*")


def tag_filter(objects: DataFrame, pipelines: list[list[Column]]) -> DataFrame:
    """Objects that pass all stages of at least one pipeline."""
    test = F.lit(False)
    for stages in pipelines:
        one = F.lit(True)
        for stage in stages:
            one = one & F.coalesce(stage, F.lit(False))
        test = test | one
    return objects.where(test)


def ring_edges(text: str) -> list[tuple[float, float, float, float]]:
    """(x1, y1, x2, y2) of all rings of a polygon file: a name, then rings of lines `lon lat` ended by END, holes marked by !."""
    out, ring = [], None
    for line in text.splitlines()[1:]:
        parts = line.split()
        if parts == ["END"]:
            if ring:
                out += [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a != b]
            ring = None
        elif len(parts) == 1:
            ring = []
        elif len(parts) == 2 and ring is not None:
            ring.append((float(parts[0]), float(parts[1])))
    return out


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """Ring edges of a polygon file, read by Spark; a region's boundary is small."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(ring_edges(text), "x1 double, y1 double, x2 double, y2 double")


def pack_columns(rows: pd.DataFrame, kinds: dict[str, str]) -> tuple[bytes, dict]:
    """(bytes, manifest): columns one after the other, each at a multiple of eight."""
    out, manifest = b"", {"count": len(rows), "columns": {}}
    for name, kind in kinds.items():
        out += b"\0" * (-len(out) % 8)
        manifest["columns"][name] = {"dtype": kind, "offset": len(out)}
        out += np.ascontiguousarray(rows[name].to_numpy(), DTYPES[kind]).tobytes()
    return out, manifest


def read_columns(data: bytes, manifest: dict) -> pd.DataFrame:
    """The inverse; an unknown type is an error."""
    columns = {}
    for name, c in manifest["columns"].items():
        if c["dtype"] not in DTYPES:
            raise ValueError(f"unknown type {c['dtype']} of column {name}")
        columns[name] = np.frombuffer(data, DTYPES[c["dtype"]], manifest["count"], c["offset"])
    return pd.DataFrame(columns)


def byte_shuffled(data: bytes, width: int) -> bytes:
    """All first bytes of numbers of one width, then all second ones, …, which compresses better."""
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()


def size_report(data: bytes, manifest: dict) -> pd.DataFrame:
    """(column, bytes, packed): the size of each column and of its shuffled bytes after compression."""
    import zlib

    rows = []
    for name, c in manifest["columns"].items():
        width = np.dtype(DTYPES[c["dtype"]]).itemsize
        part = data[c["offset"] : c["offset"] + width * manifest["count"]]
        rows.append((name, len(part), len(zlib.compress(byte_shuffled(part, width) if part else part, 9))))
    return pd.DataFrame(rows, columns=["column", "bytes", "packed"])


def geometry_once(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, geometries): each distinct geometry kept once under its hash."""
    keyed = records.withColumn("geometry_id", F.sha2(F.to_json("geometry"), 256))
    return keyed.drop("geometry"), keyed.select("geometry_id", "geometry").dropDuplicates(["geometry_id"])


def valid_trip(t: Column) -> Column:
    """Whether a parsed trip can be used."""
    date_ok = t["date"].isNull() | F.rlike(t["date"], F.lit("^\\d{4}-\\d{2}-\\d{2}$"))
    party_ok = t["party"].isNull() | t["party"].between(1, MOST_PARTY)
    return F.coalesce(t["start_type"].isNotNull() & t["start_id"].isNotNull() & t["exit_id"].isNotNull() & (F.size(t["huts"]) > 0) & date_ok & party_ok, F.lit(False))


def trip_link(trip: Column) -> Column:
    """Share link of a trip struct."""
    return F.concat(F.lit(PREFIX), share_code(F.to_json(F.struct(F.lit(1).alias("v"), trip.alias("t")))))


def from_trip_link(link: Column) -> Column:
    """The trip of a link, null if it can't be read or used."""
    code = F.when(F.startswith(link, F.lit(PREFIX)), F.substr(link, F.lit(len(PREFIX) + 1)))
    got = F.from_json(from_share_code(code), TRIP)
    return F.when((got["v"] == 1) & valid_trip(got["t"]), got["t"])


def read_trips(text: Column) -> Column:
    """Array of usable trips of a stored JSON list; entries that can't be used are skipped."""
    return F.filter(F.from_json(text, f"array<{TRIP.split(', t ', 1)[1]}>"), valid_trip)


def not_cached(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys without a good record: those still to be fetched."""
    return keys.join(cache.where("status = 'ok'").select(key), key, "left_anti")


def tiles_over(west: float, south: float, east: float, north: float, spark: SparkSession) -> DataFrame:
    """(lon, lat) of the whole-degree tiles that a box meets."""
    import math

    lons = F.sequence(F.lit(math.floor(west)), F.lit(math.ceil(east) - 1))
    lats = F.sequence(F.lit(math.floor(south)), F.lit(math.ceil(north) - 1))
    return spark.range(1).select(F.explode(lons).alias("lon")).select("lon", F.explode(lats).alias("lat"))


def info_fields(text: Column) -> Column:
    """Struct of a hut's info JSON: id, capacity by category in sum, place and an error where the id isn't a number."""
    raw = F.from_json(text, "hutId string, hutBedCategories array<struct<totalSleepingPlaces: int>>, coordinates string")
    number = raw["hutId"].try_cast("int")
    pair = lambda k: F.nullif(F.regexp_extract(raw["coordinates"], "(-?\\d+\\.\\d+)[^\\d-]+(-?\\d+\\.\\d+)", k), F.lit("")).try_cast("double")
    total = F.aggregate(F.coalesce(raw["hutBedCategories"], F.expr("CAST(array() AS array<struct<totalSleepingPlaces: int>>)")), F.lit(0), lambda a, c: a + F.coalesce(c["totalSleepingPlaces"], F.lit(0)))
    return F.struct(number.alias("id"), total.alias("capacity"), pair(1).alias("lat"), pair(2).alias("lon"), F.when(number.isNull(), "no id").alias("error"))


def header(manifest: dict) -> bytes:
    """A manifest before its bytes: length and JSON."""
    text = json.dumps(manifest, sort_keys=True).encode()
    return struct.pack("<I", len(text)) + text


DAYS = "ohrs_id int, season int, date date, status string, free_place int, capacity int"


def write_days(days: DataFrame, path: str) -> None:
    """Hut days as CSV files with a header, in the columns of DAYS."""
    days.select(*[c.split()[0] for c in DAYS.split(", ")]).write.mode("overwrite").option("header", True).csv(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAYS).option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges in order of edge_id, so that a lookup reads the row groups that can hold it alone."""
    edges.repartitionByRange("edge_id").sortWithinPartitions("edge_id").write.mode("overwrite").parquet(path)


def edge_of(spark: SparkSession, path: str, edge_id: int, columns: list[str]) -> DataFrame:
    """Some columns (points, profile) of one edge: a filter that reaches the scan."""
    return spark.read.parquet(path).where(F.col("edge_id") == edge_id).select("edge_id", *columns)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of files, or an empty one where there are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def required(df: DataFrame, column: str) -> DataFrame:
    """df, which fails when it is run if the column is missing in a row."""
    known = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"a row without {column}"))).otherwise(F.col(column))
    return df.withColumn(column, known.cast(df.schema[column].dataType))
