"""Algebra of half-open intervals [start, stop) in groups: merge, subtract, intersect, clip, cut at days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.intervals import overlaps, seconds_between
from millrace.operators.running import following, running_sum


def _edges(df: DataFrame, keys: list[str], start: str, stop: str, name: str) -> DataFrame:
    """How many intervals begin (1) or end (-1) at each moment; equal bounds come down to one row before any window."""
    live = df.where(F.col(start) < F.col(stop))
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias(name)), F.struct(F.col(stop).alias("t"), F.lit(-1).alias(name)))
    both = live.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.*")
    return both.groupBy(*keys, "t").agg(F.sum(name).alias(name))


def _dealt(edges: DataFrame, cell: str | None) -> tuple[DataFrame, str | None]:
    return (edges, None) if cell is None else (edges.withColumn("_cell", F.date_trunc(cell, "t")), "_cell")


def merge(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", cell: str | None = None) -> DataFrame:
    """The fewest intervals of each group that cover the same moments; touching ones join.

    Intervals of no length are left out. cell (such as 'day') spreads a hot
    group over its time cells.
    """
    edges, bucket = _dealt(_edges(df, keys, start, stop, "d"), cell)
    edges = running_sum(edges, keys, bucket, ["t"], F.col("d"), "open")
    bounds = edges.where("(open > 0) <> (open - d > 0)")
    bounds = following(bounds, keys, bucket, ["t"], F.col("t"), "next")
    return bounds.where("open > 0").select(*keys, F.col("t").alias(start), F.col("next").alias(stop))


def subtract(df: DataFrame, holes: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", cell: str | None = None) -> DataFrame:
    """The moments of each group's intervals that no hole covers, as the fewest intervals; cell as in merge()."""
    both = _edges(df, keys, start, stop, "a").unionByName(_edges(holes, keys, start, stop, "h"), allowMissingColumns=True)
    both = both.groupBy(*keys, "t").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"))
    both, bucket = _dealt(both, cell)
    both = running_sum(running_sum(both, keys, bucket, ["t"], F.col("a"), "in_a"), keys, bucket, ["t"], F.col("h"), "in_h")
    both = both.withColumn("now", F.expr("in_a > 0 and in_h = 0")).where("now <> (in_a - a > 0 and in_h - h = 0)")
    both = following(both, keys, bucket, ["t"], F.col("t"), "next")
    return both.where("now").select(*keys, F.col("t").alias(start), F.col("next").alias(stop))


def intersect(a: DataFrame, b: DataFrame, keys: list[str], cell: str = "day", start: str = "start", stop: str = "stop") -> DataFrame:
    """Each overlap of an interval of a with one of b in the same group, by keys and time cells.

    Intervals are dealt to the time cells they touch and meet there, so the
    join is on equal values and a group is spread over its cells; an overlap
    counts in the cell where it starts.
    """
    step = F.expr(f"interval 1 {cell}")

    def dealt(x: DataFrame, p: str) -> DataFrame:
        live = x.where(F.col(start) < F.col(stop))
        cells = F.sequence(F.date_trunc(cell, start).cast("timestamp_ntz"), F.date_trunc(cell, stop).cast("timestamp_ntz"), step)
        return live.select(*keys, F.explode(cells).alias("cell"), F.col(start).alias(p + "s"), F.col(stop).alias(p + "e"))

    met = dealt(a, "a").join(dealt(b, "b"), [*keys, "cell"]).where(overlaps(F.col("as"), F.col("ae"), F.col("bs"), F.col("be")))
    s = F.greatest("as", "bs")
    return met.where(F.date_trunc(cell, s).cast("timestamp_ntz") == F.col("cell")).select(*keys, s.alias(start), F.least("ae", "be").alias(stop))


def clip(df: DataFrame, low: Column, high: Column, start: str = "start", stop: str = "stop") -> DataFrame:
    """Intervals cut to [low, high); an open end becomes high; what lies outside goes."""
    out = df.withColumn(start, F.greatest(F.col(start), low)).withColumn(stop, F.least(F.col(stop), high))
    return out.where(F.col(start) < F.col(stop))


def cut_at_days(df: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Intervals cut at each midnight they contain, with their day."""
    last = F.col(stop) - F.expr("interval 1 microsecond")
    days = F.sequence(F.date_trunc("day", start).cast("timestamp_ntz"), F.date_trunc("day", last).cast("timestamp_ntz"), F.expr("interval 1 day"))
    out = df.where(F.col(start) < F.col(stop)).withColumn("day", F.explode(days))
    return out.withColumn(start, F.greatest(start, "day")).withColumn(stop, F.least(F.col(stop), F.col("day") + F.expr("interval 1 day")))


def cut_at_operating_days(df: DataFrame, zone: str | Column, hour: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """Intervals of UTC times cut where an operating day begins, at `hour` o'clock in a zone; with the local date of their day and its hours.

    Days follow the zone's clock, so two a year have 23 or 25 hours. Pick an
    hour that no change of the clock skips or repeats (4 to 23 are safe almost everywhere).
    """
    zone = F.lit(zone) if isinstance(zone, str) else zone
    shift = F.make_dt_interval(F.lit(0), F.lit(hour))
    local_day = lambda t: F.date_trunc("day", F.convert_timezone(F.lit("UTC"), zone, t) - shift).cast("timestamp_ntz")
    begins = lambda day: F.convert_timezone(zone, F.lit("UTC"), day + shift)
    one = F.expr("interval 1 day")
    days = F.sequence(local_day(F.col(start)), local_day(F.col(stop) - F.expr("interval 1 microsecond")), one)
    out = df.where(F.col(start) < F.col(stop)).withColumn("_day", F.explode(days))
    low, high = begins(F.col("_day")), begins(F.col("_day") + one)
    out = out.withColumn(start, F.greatest(F.col(start), low)).withColumn(stop, F.least(F.col(stop), high))
    return out.withColumn("day", F.col("_day").cast("date")).withColumn("hours", (seconds_between(low, high) / 3600).cast("int")).drop("_day")
