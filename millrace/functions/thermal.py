"""Exponential approach to a final value (Newton's law of cooling) from three equally spaced readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, c: Column) -> Column:
    return F.when(b != a, (c - b) / (b - a))


def asymptote(a: Column, b: Column, c: Column) -> Column:
    """The final value (Aitken's delta-squared); null unless the steps shrink without changing sign."""
    r = _ratio(a, b, c)
    return F.when((r > 0) & (r < 1), c + (c - b) * r / (1 - r))


def time_constant(a: Column, b: Column, c: Column, seconds: float) -> Column:
    """Seconds until the distance to the final value has fallen to 1/e; null where asymptote is."""
    r = _ratio(a, b, c)
    return F.when((r > 0) & (r < 1), -seconds / F.log(r))
