"""Half-open intervals [start, stop) as column expressions; a null stop is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(moment: Column) -> Column:
    """Microseconds of a timestamp without zone since 1970, whatever the session's zone."""
    day = F.unix_date(moment.cast("date")).cast("long") * 86_400_000_000
    return day + (F.hour(moment) * 3600 + F.minute(moment) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("long")


def seconds_between(start: Column, stop: Column) -> Column:
    """Length in seconds, as a double with microseconds."""
    return (micros(stop) - micros(start)) / F.lit(1e6)


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Do two intervals share a moment?"""
    return (a_stop.isNull() | (b_start < a_stop)) & (b_stop.isNull() | (a_start < b_stop))
