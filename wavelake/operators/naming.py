"""Small text rules as columns: file-safe names, timestamps, lists, notes, rounded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelake.operators.spectral import bound


def safe_name(name: Column) -> Column:
    """A name for one path segment: slashes become underscores."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def compact_time(stamp: Column) -> Column:
    """A timestamp for a file name: without colons and hyphens."""
    return F.translate(stamp, ":-", "")


def flat_name(name: Column) -> Column:
    """A name for a file: slashes and blanks become underscores."""
    return F.translate(name, "/ ", "__")


#: The forms of ISO 8601 that a scan time may have: date, time of day, offset.
DATE = "(\\d{4}-\\d{2}-\\d{2}|\\d{8}|\\d{4}-W\\d{2}(?:-\\d)?|\\d{4}W\\d{2}\\d?)"
CLOCK = "(\\d{2}(?::\\d{2}(?::\\d{2}(?:[.,]\\d+)?)?)?|\\d{4}(?:\\d{2}(?:[.,]\\d+)?)?)"
OFFSET = "(Z|[+-]\\d{2}(?::\\d{2}(?::\\d{2}(?:[.,]\\d+)?)?|\\d{2}(?:\\d{2}(?:[.,]\\d+)?)?)?)"


def scan_time(text: Column) -> Column:
    """`yyyy-MM-ddTHH:mm:ssZ` in UTC of an ISO 8601 timestamp with Z, with an offset, or without either (UTC); all else raises.

    The date is that of a calendar or of a week, with or without hyphens; the
    time of day may lack, or end with hours or minutes; fractions of a second
    are cut off.
    """
    trimmed = F.regexp_replace(text, "^\\s+|\\s+$", "")
    number = lambda d, at, n: F.when(F.length(d) >= at + n - 1, F.substring(d, at, n).cast("int")).otherwise(F.lit(0))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "[.,].*$", ""), "[-+:WZ]", "")
    part = lambda k: F.regexp_extract(trimmed, f"^{DATE}(?:.{CLOCK}{OFFSET}?)?$", k)

    def day(p: Column) -> Column:
        """The date, null for one that is none."""
        digits, year = p["digits"], number(p["digits"], 1, 4)
        first = F.try_make_timestamp_ntz(year, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        # 4 January lies in the first week; a week begins on Monday. The 53rd week of a year that has 52 is none.
        week, weekday = number(digits, 5, 2), F.when(F.length(digits) >= 7, number(digits, 7, 1)).otherwise(F.lit(1))
        of_week = F.date_add(F.date_sub(first, F.weekday(first)), (week - 1) * 7 + weekday - 1)
        weeks = bound(of_week, lambda d: F.when(week.between(1, 53) & weekday.between(1, 7) & (F.extract(F.lit("YEAROFWEEK"), d) == year), d))
        calendar = F.try_make_timestamp_ntz(year, number(digits, 5, 2), number(digits, 7, 2), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return F.when(p["date"].contains("W"), weeks).otherwise(calendar)

    def utc(p: Column) -> Column:
        shift = p["shift"]
        seconds = F.when(p["offset"].startswith("-"), -1).otherwise(1) * (number(shift, 1, 2) * 3600 + number(shift, 3, 2) * 60 + number(shift, 5, 2))
        known = (number(shift, 1, 2) < 24) & (number(shift, 3, 2) < 60) & (number(shift, 5, 2) < 60)
        at = bound(day(p), lambda d: F.try_make_timestamp_ntz(F.year(d), F.month(d), F.day(d), *[number(p["clock"], k, 2) for k in (1, 3, 5)]))
        return F.when(known, F.timestamp_add("SECOND", -seconds, at))

    parts = F.struct(part(1).alias("date"), bare(part(1)).alias("digits"), bare(part(2)).alias("clock"), part(3).alias("offset"), bare(part(3)).alias("shift"))
    # Each part is found once; written out in place, the expression would outgrow generated code.
    out = F.date_format(bound(parts, utc), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(out, F.raise_error(F.when(trimmed == "", "Timestamp must not be empty").otherwise(F.concat(F.lit("Invalid timestamp: "), F.coalesce(text, F.lit("null"))))))


def name_list(text: Column) -> Column:
    """The distinct names of a comma list, in order; null where there is none."""
    names = F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != ""))
    return F.when(F.size(names) > 0, names)


def merged_notes(first: Column, second: Column) -> Column:
    """Two notes joined by a semicolon, without semicolons and blanks at the ends."""
    return F.regexp_replace(F.concat(F.coalesce(first, F.lit("")), F.lit("; "), F.coalesce(second, F.lit(""))), "^[; ]+|[; ]+$", "")


def shown(names: Column, most: int = 12) -> Column:
    """The first names of a list in one line, with an ellipsis where there are more."""
    line = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(line, F.lit(", …"))).otherwise(line)


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def nearest(values: Column, target: Column) -> Column:
    """The place (from 0) of the value nearest to the target; of equals the lowest."""
    away = F.transform(values, lambda v, i: F.struct(F.abs(v - target).alias("d"), i.alias("i")))
    return F.array_min(away)["i"]


def padded(values: Column, length: int = 1024) -> Column:
    """Cut to the length, or filled with zeros up to it."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0).cast("double"), length)), 1, length)


def tiled(values: Column, length: int) -> Column:
    """Repeated up to the length; an empty array stays empty."""
    times = F.ceil(F.lit(length) / F.greatest(F.size(values), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(values, times)), 1, length)
