"""Series on a regular grid, time-weighted means, coverage, differences of snapshots, top rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.intervals import seconds_between
from millrace.operators import intervals
from millrace.operators.running import beside, following, running_sum
from millrace.operators.series import asof_join, previous


def resample(df: DataFrame, keys: list[str], time: str, tie: str, step: str, value: str, bucket: str | None = "day") -> DataFrame:
    """The last value at or before each point of a regular grid, from a key's first reading to its last.

    step is an interval such as '1 hour'; grid points are whole steps of the day.
    """
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    midnight = F.date_trunc("day", F.col("_a")).cast("timestamp_ntz")
    points = F.filter(F.sequence(midnight, F.col("_b"), F.expr(f"interval {step}")), lambda t: t >= F.col("_a"))
    grid = span.select(*keys, F.explode(points).alias(time), F.lit(None).cast(df.schema[tie].dataType).alias(tie))
    return asof_join(grid, df, keys, time, tie, None if bucket is None else F.date_trunc(bucket, time), [value]).drop(tie)


def time_weighted_mean(df: DataFrame, keys: list[str], time: str, order: list[str], bucket: str | None, value: str) -> DataFrame:
    """By key: seconds between first and last reading, and the mean of value over them, each reading holding until the next."""
    held = previous(df, keys, bucket, order, F.struct(F.col(time).alias("t"), F.col(value).alias("v")), "_p").where("_p is not null")
    held = held.withColumn("_s", seconds_between(F.col("_p.t"), F.col(time)))
    out = held.groupBy(*keys).agg(F.sum("_s").alias("seconds"), F.sum(F.col("_p.v") * F.col("_s")).alias("_w"))
    return out.select(*keys, "seconds", F.when(F.col("seconds") > 0, F.col("_w") / F.col("seconds")).alias("mean"))


def coverage(spans: DataFrame, gaps: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", cell: str | None = None) -> DataFrame:
    """By group: the seconds that its intervals cover, and the share of them that no gap takes."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum(seconds_between(F.col(start), F.col(stop))).alias(name))
    all_ = total(intervals.merge(spans, keys, start, stop, cell), "seconds")
    left = total(intervals.subtract(spans, gaps, keys, start, stop, cell), "_left")
    return beside(all_, left, keys).select(*keys, "seconds", (F.coalesce("_left", F.lit(0.0)) / F.col("seconds")).alias("share"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What changed between two snapshots with one row a key: keys, change (opened, updated or closed), new values, then old ones."""
    tagged = lambda df, p: df.select(*[F.col(k).alias(p + k) for k in keys], F.struct(*values).alias(p), F.lit(True).alias(p + "here"))
    on = [F.col("o_" + k).eqNullSafe(F.col("n_" + k)) for k in keys]
    both = tagged(old, "o_").join(tagged(new, "n_"), on, "full_outer")
    change = F.when(F.col("o_here").isNull(), "opened").when(F.col("n_here").isNull(), "closed").when(~F.col("o_").eqNullSafe(F.col("n_")), "updated")
    names = [F.when(F.col("n_here"), F.col("n_" + k)).otherwise(F.col("o_" + k)).alias(k) for k in keys]
    return both.select(*names, change.alias("change"), *[F.col(f"n_.{v}").alias(v) for v in values], *[F.col(f"o_.{v}").alias("old_" + v) for v in values]).where("change is not null")


def alarm_episodes(df: DataFrame, keys: list[str], start: str, stop: str, off_delay: float, on_delay: float) -> DataFrame:
    """Alarm periods joined over pauses of up to off_delay seconds; only those of at least on_delay seconds stay."""
    late = F.col(stop) + F.make_dt_interval(secs=F.lit(off_delay))
    joined = intervals.merge(df.select(*keys, F.col(start).alias("start"), late.alias("stop")), keys)
    out = joined.withColumn("stop", F.col("stop") - F.make_dt_interval(secs=F.lit(off_delay)))
    return out.where(seconds_between(F.col("start"), F.col("stop")) >= on_delay)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; each task passes on k rows a group at most (Spark pushes the rank below the exchange)."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def alarm_lifecycles(df: DataFrame, keys: list[str], time: str, order: list[str], alarm: Column, severity: Column, clear_after: int, bucket: str | None = None) -> DataFrame:
    """Alarms by key: opened, closed (null while open), worst severity, n rows with an alarm.

    An alarm is closed by clear_after rows without one in a row, as of the first of these.
    """
    rows = following(running_sum(df, keys, bucket, order, F.lit(1), "_i"), keys, bucket, order, F.col(time), "_miss")
    all_ = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    on = following(beside(rows, all_, keys).where(alarm), keys, bucket, order, F.col("_i"), "_next")
    on = on.withColumn("_ends", (F.coalesce("_next", F.col("_all") + 1) - F.col("_i") - 1 >= clear_after).cast("int"))
    on = running_sum(on, keys, bucket, order, F.col("_ends"), "_e").withColumn("_e", F.col("_e") - F.col("_ends"))
    out = on.groupBy(*keys, "_e").agg(F.min(time).alias("opened"), F.max(F.when(F.col("_ends") == 1, F.col("_miss"))).alias("closed"), F.max(severity).alias("worst"), F.count("*").alias("n"))
    return out.drop("_e")
