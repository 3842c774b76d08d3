"""Textbook quantities of alternating-current machines as column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apparent_power(active: Column, reactive: Column) -> Column:
    return F.sqrt(active * active + reactive * reactive)


def power_factor(active: Column, reactive: Column) -> Column:
    """Active over apparent power, signed as the active power; null without load."""
    s = apparent_power(active, reactive)
    return F.when(s > 0, active / s)


def synchronous_frequency(rpm: Column, poles: int) -> Column:
    """Hertz of a synchronous machine."""
    return rpm * poles / F.lit(120.0)


def deviation_percent(value: Column, nominal: Column) -> Column:
    """How far a value lies from nominal, in percent of it; null for a nominal of 0."""
    return F.when(nominal != 0, 100.0 * (value - nominal) / nominal)


def band_of(value: Column, bands: list[dict]) -> Column:
    """The name of the band [low, high) that holds a value; null outside all."""
    out = None
    for b in bands:
        inside = (value >= b["low"]) & (value < b["high"])
        out = F.when(inside, b["name"]) if out is None else out.when(inside, b["name"])
    return out if out is not None else F.lit(None).cast("string")
