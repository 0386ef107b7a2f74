"""What the planner's app joins and asks: identities of huts and starts, the form's query, legs' anchors, the visible tours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.functions.geo import decoded_offset
from routelake.operators import availability, search
from routelake.operators.grading import hut_class

#: Names and badges of operators of huts, and how a hut without staff is marked.
LABELS, BADGES, SELF = {"av": "Alpenverein", "sonstige": "Sonstige"}, {"av": "AV", "sonstige": "SO"}, " (Selbstversorger)"


def _named(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def class_key(operator: Column, serviced: Column) -> Column:
    return F.concat_ws(":", operator, F.when(serviced, "serviced").otherwise("self"))


def class_label(operator: Column, serviced: Column) -> Column:
    return F.concat(_named(LABELS, operator), F.when(serviced, "").otherwise(SELF))


def class_badge(operator: Column) -> Column:
    return _named(BADGES, operator)


def huts_and_partners(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(huts, partners) of map features (object_id, guid, name, category, club, elevation, ohrs_id, lon, lat). Huts without a guid are left out, as nothing could refer to them; partners keep their object id."""
    kind, serviced = hut_class(F.col("category"), F.col("club"))
    rows = features.withColumns({"hut_type": kind, "serviced": serviced})
    huts = rows.where("hut_type != 'partner' AND guid != ''").select("guid", "name", "hut_type", "serviced", "elevation", "ohrs_id", F.col("club").alias("tenant"), "lon", "lat")
    return huts, rows.where("hut_type = 'partner'").select("object_id", "name", "lon", "lat")


def resolved(ids: DataFrame, huts: DataFrame) -> DataFrame:
    """Places in a payload (pos, guid) with the hut of each guid; unknown ones keep their place, with nulls."""
    return ids.join(huts, "guid", "left").select("pos", "guid", *[c for c in huts.columns if c != "guid"])


def start_index(*layers: DataFrame) -> DataFrame:
    """(start_id, start_type, name, lon, lat) of layers with these columns; of one id the last layer's row holds, and rows without an id are left out."""
    out = None
    for k, layer in enumerate(layers):
        part = layer.where("start_id IS NOT NULL").select("start_id", F.struct(F.lit(k).alias("layer"), "start_type", "name", "lon", "lat").alias("row"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("start_id").agg(F.max_by("row", "row.layer").alias("row")).select("start_id", "row.start_type", "row.name", "row.lon", "row.lat")


def query_of(form: dict, classes: DataFrame, legs: tuple[int, int], **more) -> search.Query:
    """The search that a form asks for: classes has (hut_id, operator, serviced), legs the least and most legs. The shortest leg is half the longest; empty or unreadable bounds don't bind, an empty greatest height asks for none."""

    def number(text) -> float | None:
        try:
            value = float(text)
        except (TypeError, ValueError):
            return None
        return value if abs(value) < float("inf") else None

    keys = [F.lit(k) for k in sorted(form["classes"])]
    allowed = classes.where(class_key(F.col("operator"), F.col("serviced")).isin(*keys) if keys else F.lit(False)).select("hut_id")
    hours = float(form["leg_hours"])
    return search.Query(
        mode=form["mode"], legs_min=legs[0], legs_max=legs[1], max_leg_h=hours, min_leg_h=hours / 2, ascent_cap=number(form.get("leg_ascent")), max_ele=number(form.get("greatest_height")), ferrata=form["via_ferrata"], allowed=allowed, **more
    )


def visible(tours: DataFrame, beds: DataFrame | None, fit: Column, key: str, descending: bool = False, places: DataFrame | None = None, box: tuple[float, float, float, float] | None = None, focused: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups by start, tours to list): tours without a full night, with their fit, sorted by key. Focused tours (tour_id) alone if there are any; else those whose place (tour_id, lon, lat) lies in the box, if there is one."""
    shown = tours if beds is None else availability.without_full_nights(tours, beds)
    groups = search.by_start(shown)
    ranked = shown.withColumn("score", fit)
    if focused is not None:
        ranked = ranked.join(focused.select("tour_id").distinct(), "tour_id", "left_semi")
    elif box is not None:
        inside = places.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
        ranked = ranked.join(inside.select("tour_id").distinct(), "tour_id", "left_semi")
    return groups, search.sorted_tours(ranked, key, descending)


def leg_anchors(legs: DataFrame, approaches: DataFrame, exits: DataFrame, huts: DataFrame) -> DataFrame:
    """(edge_id, anchors): anchors of legs (edge_id) in the edge's own direction, from its approach row, else from the exits' rows (edge_id, hut_id, offsets array of latitude and longitude in turn), around the hut's place (hut_id, lon, lat); null without any."""
    a = approaches.select("edge_id", F.struct("hut_id", "offsets").alias("a"))
    b = exits.select("edge_id", F.struct("hut_id", "offsets").alias("b"))
    rows = legs.join(a, "edge_id", "left").join(b, "edge_id", "left").withColumn("of", F.coalesce("a", "b"))
    rows = rows.select("edge_id", "of.hut_id", "of.offsets").join(huts.select("hut_id", "lon", "lat"), "hut_id", "left")
    point = lambda k: F.struct(decoded_offset(F.get("offsets", 2 * k + 1), F.col("lon")).alias("lon"), decoded_offset(F.get("offsets", 2 * k), F.col("lat")).alias("lat"))
    pairs = F.floor(F.size("offsets") / 2).cast("int")
    points = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), point))
    return rows.select("edge_id", F.when(F.col("lon").isNotNull(), points).alias("anchors"))


def anchor_names(count: int) -> list[str]:
    """Columns of so many anchors spread evenly over an edge."""
    return [f"a{round(100 * (k + 1) / (count + 1))}_{axis}" for k in range(count) for axis in ("dlat", "dlng")]


def day_count(first: Column, last: Column) -> Column:
    """Days from the first to the last, both included."""
    return F.datediff(last, first) + 1


def new_trip(key: Column, name: Column, now: Column, start: Column, huts: Column, exit_: Column, day: Column, party: Column) -> Column:
    """A trip as it is first stored: created and changed now."""
    return F.struct(key.alias("id"), name.alias("name"), now.alias("createdAt"), now.alias("updatedAt"), day.alias("startDate"), party.alias("partySize"), start.alias("start"), huts.alias("huts"), exit_.alias("exit"))
