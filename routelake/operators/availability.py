"""Nights and beds. What isn't known, for want of an id, a fetch or a night, never bars a tour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a hut that leave no bed.
CLOSED = ("HUT_CLOSED_TO_PUBLIC", "RESERVATION_NOT_POSSIBLE")


def night_kind(status: Column, free: Column, party: Column) -> Column:
    """free, few (under twice the party), full or unknown, by a day's status and free places by category (array)."""
    places = F.aggregate(free, F.lit(0), lambda a, x: a + x)
    known = F.when(places <= 0, "full").when(places < 2 * party, "few").otherwise("free")
    return F.when(status.isNull() | (status == "TECHNICAL_ERROR"), "unknown").when(status.isin(*CLOSED), "full").when(free.isNull() | (F.size(free) == 0), "unknown").otherwise(known)


def nights(tours: DataFrame, beds: DataFrame) -> DataFrame:
    """(tour_id, night, hut_id, state) of each night, from 1, of tours (tour_id, huts); beds has (hut_id, night, free). state: free, full or unknown."""
    each = tours.select("tour_id", F.posexplode("huts").alias("pos", "hut_id")).select("tour_id", (F.col("pos") + 1).alias("night"), "hut_id")
    joined = each.join(beds, ["hut_id", "night"], "left")
    return joined.select("tour_id", "night", "hut_id", F.when(F.col("free").isNull(), "unknown").when(F.col("free"), "free").otherwise("full").alias("state"))


def stay_verdicts(states: DataFrame) -> DataFrame:
    """(tour_id, verdict): blocked by one full night, else unclear by one unknown, else bookable."""
    has = lambda s: F.bool_or(F.col("state") == s)
    return states.groupBy("tour_id").agg(F.when(has("full"), "blocked").when(has("unknown"), "unclear").otherwise("bookable").alias("verdict"))


def without_full_nights(tours: DataFrame, beds: DataFrame) -> DataFrame:
    full = nights(tours, beds).where("state = 'full'").select("tour_id").distinct()
    return tours.join(full, "tour_id", "left_anti")


def detail_days(details: DataFrame) -> DataFrame:
    """(hut_id, day, status, free) of details (hut_id, days array<struct<day, status, categories array<struct<language, free>>>>): categories of the German texts; a failed fetch is one day of TECHNICAL_ERROR."""
    failed = F.expr("array(struct(CAST(NULL AS DATE) AS day, 'TECHNICAL_ERROR' AS status, CAST(array() AS array<struct<language: string, free: int>>) AS categories))")
    each = details.select("hut_id", F.explode(F.when(F.col("days").isNull(), failed).otherwise(F.col("days"))).alias("d"))
    german = F.filter("d.categories", lambda c: c["language"] == "DE_DE")
    return each.select("hut_id", "d.day", "d.status", F.transform(german, lambda c: c["free"]).alias("free"))


def night_text(kind: Column, places: Column) -> Column:
    return F.when(kind.isin("free", "few"), F.when(places == 1, "1 Platz frei").otherwise(F.concat(places.cast("string"), F.lit(" Plätze frei")))).when(kind == "full", "ausgebucht").otherwise("Plätze unbekannt")
