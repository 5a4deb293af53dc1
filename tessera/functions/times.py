"""Times that come as text in several forms, and local times as instants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they are written.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# The forms of times as text that are read, by name.
FORMS = {
    "offset": r"^(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(Z|[+-]\d\d:?\d\d)$",
    "iso": r"^(\d{4})-(\d\d)-(\d\d) (\d\d):(\d\d):(\d\d)$",
    "dotted": r"^(\d\d)\.(\d\d)\.(\d{4}) (\d\d):(\d\d):(\d\d)$",
    "named": r"^(\d\d) ([A-Z][a-z]{2}) (\d{4}) (\d\d):(\d\d)$",
    "slashed": r"^(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d)$",
    "half_day": r"^(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d) ([AP]M)$",
    "compact": r"^(\d{4})(\d\d)(\d\d)$",
    "seconds": r"^(\d{10})$",
    "millis": r"^(\d{13})$",
}


def form(raw: Column) -> Column:
    """The name of the form that ``raw``, without blanks around it, has; null if none of FORMS."""
    text = F.trim(raw)
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in FORMS.items()])


def slashed_order(raw: Column, name: Column) -> Column:
    """Whether the day comes first in a slashed time (``name``: its form): true or false where only one order is a date, else null."""
    first, second = (F.regexp_extract(F.trim(raw), FORMS["slashed"], g).try_cast("int") for g in (1, 2))
    return F.when(name == "slashed", F.when((first > 12) & (second <= 12), True).when((first <= 12) & (second > 12), False))


def parts_of(raw: Column, name: Column, day_first: Column) -> Column:
    """The date and time that ``raw`` of form ``name`` names, without a zone; null if it has no form or is no date. ``day_first`` decides slashed times."""
    text = F.trim(raw)

    def at(name: str, *groups: int) -> list[Column]:
        return [F.regexp_extract(text, FORMS[name], g).try_cast("int") for g in groups]

    def made(year, month, day, hour=None, minute=None, second=None) -> Column:
        hour, minute, second = (F.lit(0) if x is None else x for x in (hour, minute, second))
        # A second of 60 is the next minute to Spark.
        return F.when((second < 60) & (hour < 24), F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)")))

    def slashed(name: str, first: Column) -> list[Column]:
        one, two, year = at(name, 1, 2, 3)
        return [year, F.when(first, two).when(~first, one), F.when(first, one).when(~first, two)]

    day, year, *clock = at("named", 1, 3, 4, 5)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, FORMS["named"], 2)).cast("int")
    dotted = at("dotted", 3, 2, 1, 4, 5, 6)
    twelve, minute = at("half_day", 4, 5)
    hour = F.when(twelve.between(1, 12), twelve % 12 + F.when(text.endswith("PM"), 12).otherwise(0))
    ways = {
        "offset": made(*at("offset", 1, 2, 3, 4, 5, 6)),
        "iso": made(*at("iso", 1, 2, 3, 4, 5, 6)),
        "dotted": made(*dotted),
        "named": made(year, month, day, *clock),
        "slashed": made(*slashed("slashed", day_first), *at("slashed", 4, 5)),
        "half_day": made(*slashed("half_day", F.lit(False)), hour, minute),
        "compact": made(*at("compact", 1, 2, 3)),
    }
    return reduce(lambda got, way: got.when(name == way, ways[way]), list(ways)[1:], F.when(name == "offset", ways["offset"]))


def stated_instant(raw: Column, name: Column, at: Column) -> Column:
    """The instant, as a time in UTC, that ``raw`` of form ``name`` states by itself: with an offset to ``at`` (its ``parts_of``), or as seconds or milliseconds of the epoch; else null."""
    text = F.trim(raw)
    zone = F.regexp_extract(text, FORMS["offset"], 7)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    ahead = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (
        F.when(name == "offset", F.when(zone == "Z", at).otherwise(at - F.make_dt_interval(mins=ahead)))
        .when(name == "seconds", epoch + F.make_dt_interval(secs=text.try_cast("decimal(18,6)")))
        .when(name == "millis", epoch + F.make_dt_interval(secs=(text.try_cast("decimal(13,0)") / 1000).cast("decimal(18,6)")))
    )


def local_instants(local: Column, zone: Column) -> Column:
    """The instants, as times in UTC, that a local time may be: ``first``, ``last`` and whether the clock ``skipped`` it.

    ``first`` and ``last`` differ where the clock was set back over it. A skipped time is read by
    the offset before the change, so it falls after it. The session's zone plays no part. The
    offsets of a day before and after are compared, so changes less than two days apart aren't told.
    """
    day = F.expr("INTERVAL '1' DAY")

    def by_offset_at(near: Column) -> Column:
        return local - (F.convert_timezone(F.lit("UTC"), zone, near) - near)

    before, after = by_offset_at(local - day), by_offset_at(local + day)

    def real(u: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), zone, u) == local

    first = F.when(real(before), before).when(real(after), after).otherwise(before)
    last = F.when(real(after), after).otherwise(before)
    changed = F.struct(first.alias("first"), last.alias("last"), (~real(before) & ~real(after)).alias("skipped"))
    return F.when(before == after, F.struct(before.alias("first"), before.alias("last"), F.lit(False).alias("skipped"))).when(local.isNotNull() & zone.isNotNull(), changed)
