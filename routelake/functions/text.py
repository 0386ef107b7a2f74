"""String and date functions: names, labels, links, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """Lower case, letters and digits of the alphabet used for tour names alone."""
    return F.regexp_replace(F.lower(name), "[^a-zäöüß0-9]", "")


def guids(text: Column) -> Column:
    """All {…} tokens in upper case."""
    return F.transform(F.regexp_extract_all(text, F.lit("(\\{[^}]+\\})"), F.lit(1)), F.upper)


def number_of_feature(feature_id: Column) -> Column:
    """The number behind a feature id's letters, null without one."""
    return F.nullif(F.regexp_replace(feature_id, "^\\D+", ""), F.lit("")).try_cast("long")


def area_id(code: Column) -> tuple[Column, Column]:
    """(way or relation id, kind) of an area code: even ones are ways, odd ones relations."""
    return F.floor(code / 2).cast("long"), F.when(F.pmod(code, F.lit(2)) == 0, "way").otherwise("relation")


def german_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def day_month(day: Column) -> Column:
    return F.date_format(day, "dd.MM.")


def signpost_time(hours: Column) -> Column:
    """Quarter hours as on signposts: 2¼ Std."""
    quarters = F.floor(hours * 4 + 0.5).cast("long")
    whole, rest = F.floor(quarters / 4).cast("long"), F.pmod(quarters, F.lit(4))
    part = F.element_at(F.array(*map(F.lit, ("", "¼", "½", "¾"))), (rest + 1).cast("int"))
    return F.concat(F.when((whole > 0) | (rest == 0), whole.cast("string")).otherwise(""), part, F.lit(" Std"))


def kilometres(metres: Column) -> Column:
    return F.format_string("%.1f km", metres / 1000)


def metres(value: Column) -> Column:
    return F.concat(F.translate(F.format_number(value, 0), ",", "."), F.lit(" m"))


def share_code(json: Column) -> Column:
    """URL-safe base 64 without padding and line ends."""
    return F.rtrim(F.translate(F.base64(json.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def from_share_code(code: Column) -> Column:
    """The text of a share code, null if it isn't one."""
    padded = F.concat(F.translate(code, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(code), F.lit(4)).cast("int")))
    return F.when(F.rlike(code, F.lit("^[A-Za-z0-9_-]+$")), F.try_to_binary(padded, F.lit("base64")).cast("string"))


def booking_link(base: Column, ohrs_id: Column, day: Column) -> Column:
    """Link to book one night of a hut from a day on."""
    return F.concat(base, F.lit("/"), ohrs_id.cast("string"), F.lit("/wizard?dateFrom="), german_date(day), F.lit("&dateTo="), german_date(F.date_add(day, 1)))


def tour_key(start: Column, huts: Column, exit_: Column) -> Column:
    return F.concat_ws("|", start.cast("string"), F.array_join(huts.cast("array<string>"), ">"), exit_.cast("string"))


def content_hash(value: Column) -> Column:
    return F.sha2(F.to_json(F.struct(value.alias("v"))), 256)
