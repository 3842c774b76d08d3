"""Series with gaps: rows and pairs that gaps spoil, states as intervals, integrals and rates that leave gaps out.

A pair is a row and the one before it in its series. Gaps are half-open
intervals [start, stop) by key; a null stop is one without an end. Gaps are
merged first, so each moment has one gap at most and an as-of join finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.intervals import seconds_between
from millrace.operators import intervals
from millrace.operators.running import beside, following, last_known, previous, running_sum
from millrace.operators.series import asof_join

FOREVER = "9999-01-01"


def _merged(gaps: DataFrame, keys: list[str], bucket: str | None) -> DataFrame:
    ends = gaps.withColumn("stop", F.coalesce("stop", F.lit(FOREVER).cast("timestamp_ntz")))
    return intervals.merge(ends.select(*keys, "start", "stop"), keys, cell=bucket)


def _gap_at(df: DataFrame, gaps: DataFrame, keys: list[str], time: str, tie: str, bucket: str | None) -> DataFrame:
    """df with _gap_stop: where the last gap that began at or before each row ends."""
    found = _merged(gaps, keys, bucket).select(*keys, F.col("start").alias(time), F.lit(None).cast(df.schema[tie].dataType).alias(tie), F.col("stop").alias("_gap_stop"))
    return asof_join(df, found, keys, time, tie, F.date_trunc(bucket, time) if bucket else None, ["_gap_stop"])


def outside_gaps(df: DataFrame, gaps: DataFrame, keys: list[str], time: str, tie: str, bucket: str | None = None) -> DataFrame:
    """The rows whose time no gap covers."""
    marked = _gap_at(df, gaps, keys, time, tie, bucket)
    return marked.where(F.col("_gap_stop").isNull() | (F.col("_gap_stop") <= F.col(time))).drop("_gap_stop")


def pairs(df: DataFrame, gaps: DataFrame, keys: list[str], time: str, order: list[str], value: str, max_pause: float, bucket: str | None = None) -> DataFrame:
    """Rows with before (t, v of the row before) and broken: a gap lies between or overlaps the two, or they are more than max_pause seconds apart.

    The first row of a series has no pair and is left out. A gap that only
    touches the pair (it ends at the earlier row, or begins at the later one)
    breaks nothing.
    """
    tie = next(c for c in order if c != time)
    both = previous(df, keys, bucket, order, F.struct(F.col(time).alias("t"), F.col(value).alias("v")), "before").where("before is not null")
    # a gap that begins at the later row is not meant: ask a moment before
    asked = both.withColumn("_at", F.col(time)).withColumn(time, F.col(time) - F.expr("interval 1 microsecond"))
    marked = _gap_at(asked, gaps, keys, time, tie, bucket).withColumn(time, F.col("_at")).drop("_at")
    across = F.coalesce(F.col("_gap_stop") > F.col("before.t"), F.lit(False))
    return marked.withColumn("broken", across | (seconds_between(F.col("before.t"), F.col(time)) > max_pause)).drop("_gap_stop")


def seconds_where(paired: DataFrame, keys: list[str], time: str, condition: Column, name: str = "seconds") -> DataFrame:
    """Per key the seconds of unbroken pairs() whose earlier row meets a condition on before.v."""
    held = F.when(condition & ~F.col("broken"), seconds_between(F.col("before.t"), F.col(time)))
    return paired.groupBy(*keys).agg(F.coalesce(F.sum(held), F.lit(0.0)).alias(name))


def rates(paired: DataFrame, keys: list[str], time: str, value: str, least: float = 1e-6) -> DataFrame:
    """Per key over unbroken pairs(): greatest_rate, fastest_rise and fastest_fall (null without one), in units a second."""
    seconds = seconds_between(F.col("before.t"), F.col(time))
    rate = F.when(~F.col("broken") & (seconds >= least), (F.col(value) - F.col("before.v")) / seconds)
    with_rate = paired.withColumn("_r", rate)
    return with_rate.groupBy(*keys).agg(F.max(F.abs("_r")).alias("greatest_rate"), F.max(F.when(F.col("_r") > 0, F.col("_r"))).alias("fastest_rise"), F.min(F.when(F.col("_r") < 0, F.col("_r"))).alias("fastest_fall"))


def falling_fronts(df: DataFrame, keys: list[str], order: list[str], value: str, level: float, bucket: str | None = None) -> DataFrame:
    """Per key how often value goes from level or above to below it from one row to the next."""
    both = previous(df, keys, bucket, order, F.col(value), "_before")
    return both.groupBy(*keys).agg(F.count_if((F.col("_before") >= level) & (F.col(value) < level)).alias("fronts"))


def state_intervals(df: DataFrame, keys: list[str], time: str, order: list[str], state: Column, until: Column, bucket: str | None = None) -> DataFrame:
    """A step function as intervals: each row where state holds counts until the next row, the last until `until`; touching ones join."""
    held = following(df, keys, bucket, order, F.col(time), "_next").where(state)
    spans = held.select(*keys, F.col(time).alias("start"), F.coalesce("_next", until).alias("stop"))
    return intervals.merge(spans, keys, cell=bucket)


def tail_gaps(df: DataFrame, keys: list[str], time: str, until: Column, max_pause: float) -> DataFrame:
    """By key the open gap from its last row to `until`, if that is more than max_pause seconds: keys, start, stop (null)."""
    last = df.groupBy(*keys).agg(F.max(time).alias("start"))
    return last.where(seconds_between(F.col("start"), until) > max_pause).select(*keys, "start", F.lit(None).cast("timestamp_ntz").alias("stop"))


def weighted_quality(spans: DataFrame, keys: list[str], quality: str, default: float = 1.0) -> DataFrame:
    """By key the mean of quality over the lengths of its intervals; default where these are 0 in all."""
    seconds = seconds_between(F.col("start"), F.col("stop"))
    total = spans.groupBy(*keys).agg(F.sum(seconds).alias("seconds"), F.sum(seconds * F.col(quality)).alias("_q"))
    return total.select(*keys, "seconds", F.when(F.col("seconds") > 0, F.col("_q") / F.col("seconds")).otherwise(F.lit(default)).alias("quality"))


def deadband_level(df: DataFrame, keys: list[str], order: list[str], value: str, edges: list[float], margin: float, bucket: str | None = None, name: str = "level") -> DataFrame:
    """The number of edges below a value, with a dead band of margin on either side of each.

    Every edge is a Schmitt trigger of its own (on from edge + margin, off
    below edge - margin, at first by the plain comparison), and the level is
    how many are on; so the state needs no row-by-row fold.
    """
    first = df.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_start"))
    out = df
    for i, edge in enumerate(edges):
        decided = F.when(F.col(value) >= edge + margin, 1).when(F.col(value) < edge - margin, 0)
        out = last_known(out, keys, bucket, order, decided, f"_on{i}")
    out = beside(out, first, keys)
    on = sum((F.coalesce(F.col(f"_on{i}"), (F.col("_start.v") >= edge).cast("int")) for i, edge in enumerate(edges)), F.lit(0))
    return out.withColumn(name, on).drop("_start", *[f"_on{i}" for i in range(len(edges))])


def confirmed_segments(runs: DataFrame, keys: list[str], time: str, state: str, run: str, n: int) -> DataFrame:
    """Numbered runs of states -> segments (keys, state, start, stop) that begin where a run of n rows or more began.

    Shorter runs belong to the segment before; a boundary lies at the first row
    of the run that confirms it, not where it was confirmed. Runs of one state
    with only short ones between are one segment. The last has no stop; a
    series without a confirmed run has none.
    """
    spans = runs.groupBy(*keys, run).agg(F.first(state).alias("state"), F.min(time).alias("start"), F.count("*").alias("n")).where(F.col("n") >= n)
    spans = previous(spans, keys, None, [run], F.struct("state"), "_b").where(F.col("_b").isNull() | ~F.col("_b.state").eqNullSafe(F.col("state")))
    return following(spans, keys, None, [run], F.col("start"), "stop").select(*keys, "state", "start", "stop")


def cut_at(spans: DataFrame, cuts: DataFrame, keys: list[str], at: str, bucket: str | None = None) -> DataFrame:
    """Disjoint intervals of each key cut at the moments that lie strictly inside them: keys, start, stop, piece (from 1), is_cut."""
    whole = spans.where("start < stop").select(*keys, F.col("start").alias("t"), F.struct("start", "stop").alias("_s"), F.lit(False).alias("is_cut"))
    inner = cuts.select(*keys, F.col(at).alias("t"), F.lit(None).cast(whole.schema["_s"].dataType).alias("_s"), F.lit(True).alias("is_cut")).distinct()
    both = whole.unionByName(inner).withColumn("_k", F.col("is_cut").cast("int"))
    both = both if bucket is None else both.withColumn("_cell", F.date_trunc(bucket, "t"))
    found = last_known(both, keys, bucket and "_cell", ["t", "_k"], F.col("_s"), "_in")
    points = found.where("_in is not null and (not is_cut or (t > _in.start and t < _in.stop))")
    inside = [*keys, "_start"]
    points = points.withColumn("_start", F.col("_in.start"))
    points = following(points, inside, None, ["t"], F.col("t"), "_next")
    points = points.withColumn("stop", F.coalesce("_next", "_in.stop"))
    out = running_sum(points, inside, None, ["t"], F.lit(1), "piece")
    return out.select(*keys, F.col("t").alias("start"), "stop", F.col("piece").cast("long").alias("piece"), "is_cut")
