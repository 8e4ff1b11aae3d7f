"""Column functions that turn sensor text into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column | str) -> Column:
    """Text to DOUBLE; unparseable, NaN and NULL become NULL.

    A cast would also read a Java type suffix (``1.5f``), which is no number in a log.
    """
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & ~F.trim(text).rlike("[0-9.][dDfF]$"), value)


def current(text: Column | str) -> Column:
    """Phase current: unparseable becomes 0, negatives are clipped to 0."""
    return F.greatest(F.coalesce(number(text), F.lit(0.0)), F.lit(0.0))


def grid_frequency(text: Column | str) -> Column:
    """Grid frequency: unparseable becomes 50 Hz."""
    return F.coalesce(number(text), F.lit(50.0))


def clock_seconds(text: Column | str) -> Column:
    """``MM:SS.f`` to seconds; anything else is read as plain seconds."""
    parts = F.split(F.trim(text), ":")
    minutes = F.element_at(parts, 1).try_cast("int")
    seconds = F.element_at(parts, 2).try_cast("double")
    return F.when(F.size(parts) == 2, minutes * 60.0 + seconds).otherwise(
        F.trim(text).try_cast("double"))


def iso_timestamp(text: Column | str) -> Column:
    return F.trim(text).try_cast("timestamp")


# Accepted header spellings.
HEADERS = {
    "timestamp": "timestamp_str", "time": "timestamp_str", "datetime": "timestamp_str",
    "i1": "i1", "i2": "i2", "i3": "i3",
    "iavg": "i_avg_src", "iaverage": "i_avg_src",
    "freq": "frequency", "frequency": "frequency", "hz": "frequency",
}


def canonical_name(header: str, any_time_header: bool) -> str | None:
    """Canonical column of a raw header, or None if it is not a known one."""
    plain = header.strip().lower().replace(" ", "").replace("_", "")
    if any_time_header and ("time" in plain or "stamp" in plain):
        return "timestamp_str"
    return HEADERS.get(plain)


def canonical_column(header: str, any_time_header: Column) -> Column:
    """The same for a column of headers."""
    plain = F.regexp_replace(F.lower(F.trim(header)), "[ _]", "")
    known = F.create_map(*[F.lit(x) for pair in HEADERS.items() for x in pair])
    return F.when(any_time_header & (plain.contains("time") | plain.contains("stamp")), "timestamp_str").otherwise(F.try_element_at(known, plain))
