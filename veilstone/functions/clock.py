"""Time and duration formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[0-9]+(\.[0-9]*)?\s*$|^\s*\.[0-9]+\s*$"
WHOLE = r"^\s*[0-9]+\s*$"


def fmt_timestamp(seconds: Column) -> Column:
    """``H:MM:SS.mmm`` from whole milliseconds, half to even; negatives count as 0."""
    ms = F.rint(F.greatest(F.lit(0.0), seconds) * 1000).cast("long")
    s = (ms - ms % 1000) / 1000
    s = s.cast("long")
    return F.format_string("%d:%02d:%02d.%03d", ((s - s % 3600) / 3600).cast("long"), ((s % 3600 - s % 60) / 60).cast("long"), s % 60, ms % 1000)


def parse_timestamp(text: Column) -> Column:
    """``S[.mmm]``, ``M:SS[.mmm]`` or ``H:MM:SS[.mmm]`` in seconds; null for anything else. Exponents,
    infinities and signs are not numbers here."""
    parts = F.split(F.trim(text), ":")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i))

    def number(x: Column) -> Column:
        return F.when(x.rlike(NUMBER), F.trim(x)).try_cast("double")

    def whole(x: Column) -> Column:
        return F.when(x.rlike(WHOLE), F.trim(x)).try_cast("double")

    return (
        F.when(n == 1, number(part(1)))
        .when(n == 2, whole(part(1)) * 60 + number(part(2)))
        .when(n == 3, whole(part(1)) * 3600 + whole(part(2)) * 60 + number(part(3)))
    )


def fmt_duration(seconds: Column) -> Column:
    """``HH:MM:SS``, truncated."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", ((s - s % 3600) / 3600).cast("long"), ((s % 3600 - s % 60) / 60).cast("long"), s % 60)


def offset_seconds(offset: Column) -> Column:
    """Seconds of a fixed offset ``+HH:MM`` or ``+HHMM``; 0 where it is absent or malformed."""
    pattern = r"^([+-])(\d{2}):?(\d{2})$"
    size = F.regexp_extract(offset, pattern, 2).try_cast("int") * 3600 + F.regexp_extract(offset, pattern, 3).try_cast("int") * 60
    return F.coalesce(F.when(F.regexp_extract(offset, pattern, 1) == "-", -size).otherwise(size), F.lit(0))


def offset_clock(ts: Column, offset: Column) -> Column:
    """Local ``YYYY-MM-DD HH:MM:SS ±HHMM`` at a fixed offset (bad offsets: UTC)."""
    sec = offset_seconds(offset)
    local = F.timestamp_seconds(F.unix_timestamp(ts) + sec)
    mins = (F.abs(sec) / 60).cast("long")
    tag = F.format_string("%s%02d%02d", F.when(sec < 0, F.lit("-")).otherwise(F.lit("+")), ((mins - mins % 60) / 60).cast("long"), mins % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss "), tag)


def iso_epoch(text: Column) -> Column:
    """ISO-8601 text as epoch seconds; null if it isn't a time."""
    return F.try_to_timestamp(text).cast("double")
