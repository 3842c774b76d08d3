"""Values by a table of fixed names, with defaults, as a column expression."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def mapped(value: Column, known: dict[str, str], blank: str | None, other: str | None) -> Column:
    """known's value of a text, without regard to case and blanks round it; blank for null and empty ones, other for those it lacks."""
    text = F.lower(F.trim(value))
    pairs = {k.strip().lower(): v for k, v in known.items()}
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())]), text) if pairs else F.lit(None)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(blank)).otherwise(F.coalesce(found, F.lit(other)))
