"""Operators on sampled series: as-of joins, fills, hysteresis, debouncing, runs, episodes, accumulators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.intervals import seconds_between
from millrace.operators.running import beside, last_known, previous, reflected_sum, running_sum


def forward_fill(df: DataFrame, keys: list[str], time: str, order: list[str], bucket: str | None, value: str, max_age: float | None = None, name: str = "filled") -> DataFrame:
    """The last non-null value of a series, unless it is older than max_age seconds."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    out = last_known(df, keys, bucket, order, seen, "_seen")
    fresh = F.lit(True) if max_age is None else seconds_between(F.col("_seen.t"), F.col(time)) <= max_age
    return out.withColumn(name, F.when(fresh, F.col("_seen.v"))).drop("_seen")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, tie: str, bucket: Column | None, values: list[str], max_age: float | None = None) -> DataFrame:
    """Rows of left with the values of the last right row of the same keys at or before their time.

    One union and a carry instead of a range join: the work is linear, however
    many rows a key has on either side. Of right rows at one time the greatest
    tie (a column of both sides) counts. Values older than max_age seconds are null.
    """
    found = F.struct(F.col(time).alias("t"), *values)
    cols = [*keys, time, tie]
    rest = [c for c in left.columns if c not in cols]
    a = left.select(*cols, F.struct(*rest).alias("_l") if rest else F.struct(F.lit(1).alias("x")).alias("_l"), F.lit(1).alias("_side"))
    b = right.select(*cols, found.alias("_r"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both if bucket is None else both.withColumn("_bucket", bucket)
    out = last_known(both, keys, None if bucket is None else "_bucket", [time, "_side", tie], F.col("_r"), "_found").where("_side = 1")
    fresh = F.lit(True) if max_age is None else seconds_between(F.col("_found.t"), F.col(time)) <= max_age
    return out.select(*cols, *[F.col(f"_l.{c}").alias(c) for c in rest], *[F.when(fresh, F.col(f"_found.{v}")).alias(v) for v in values])


def hysteresis(df: DataFrame, keys: list[str], order: list[str], bucket: str | None, value: str, low: float, high: float, name: str = "on") -> DataFrame:
    """A Schmitt trigger: on from a value at or above high until one at or below low; off at first.

    Only such values decide, so the state is the last decision carried forward.
    """
    decided = F.when(F.col(value) >= high, True).when(F.col(value) <= low, False)
    return last_known(df, keys, bucket, order, decided, name).withColumn(name, F.coalesce(name, F.lit(False)))


def runs(df: DataFrame, keys: list[str], order: list[str], bucket: str | None, state: str, name: str = "run") -> DataFrame:
    """Numbers the runs of equal states of a series from 1 (gaps and islands); null is a state."""
    out = previous(df, keys, bucket, order, F.struct(F.col(state).alias("s")), "_before")
    new = F.when(F.col("_before").isNull() | ~F.col("_before.s").eqNullSafe(F.col(state)), 1).otherwise(0)
    return running_sum(out, keys, bucket, order, new, name).drop("_before")


def debounce(df: DataFrame, keys: list[str], order: list[str], bucket: str | None, state: str, n: int, name: str = "stable") -> DataFrame:
    """A state counts from the n-th equal reading in a row on; until then the one before holds (null at first)."""
    out = runs(df, keys, order, bucket, state, "_run")
    out = running_sum(out, [*keys, "_run"], bucket, order, F.lit(1), "_nth")
    out = last_known(out, keys, bucket, order, F.when(F.col("_nth") >= n, F.struct(F.col(state).alias("s"))), "_held")
    return out.withColumn(name, F.col("_held.s")).drop("_run", "_nth", "_held")


def episodes(df: DataFrame, keys: list[str], time: str, order: list[str], bucket: str | None, max_gap: float) -> DataFrame:
    """Rows of a series that follow each other within max_gap seconds: keys, episode, started, ended, n."""
    out = previous(df, keys, bucket, order, F.col(time), "_before")
    new = F.when(F.col("_before").isNull() | (seconds_between(F.col("_before"), F.col(time)) > max_gap), 1).otherwise(0)
    out = running_sum(out, keys, bucket, order, new, "episode")
    return out.groupBy(*keys, "episode").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n"))


def resettable_sum(df: DataFrame, keys: list[str], order: list[str], bucket: str | None, value: Column, reset: Column, name: str = "total") -> DataFrame:
    """The sum of value since the last row where reset holds (that row starts anew)."""
    out = running_sum(df, keys, bucket, order, F.when(reset, 1).otherwise(0), "_era")
    return running_sum(out, [*keys, "_era"], bucket, order, value, name).drop("_era")


def clipped_decay(df: DataFrame, keys: list[str], order: list[str], bucket: str | None, gain: Column, loss: Column, name: str = "level") -> DataFrame:
    """A level that rises by gain and falls by loss, but not below 0."""
    return reflected_sum(df, keys, bucket, order, gain - loss, name)


def slopes(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Per group the least-squares slope of value per hour; null for fewer than two moments."""
    hours = seconds_between(F.lit("2024-01-01").cast("timestamp_ntz"), F.col(time)) / 3600
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.regr_slope(F.col(value), hours).alias("slope_per_hour"))


def robust_summary(df: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """Per group: n, least, greatest, first and last value, median, MAD.

    Medians are exact: a task holds the distinct values of a group, with counts.
    """
    at = F.struct(time, tie)
    base = df.where(F.col(value).isNotNull())
    first = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.median(value).alias("median"))
    gaps = beside(base.select(*keys, value), first.select(*keys, F.col("median").alias("_m")), keys, "inner")
    mad = gaps.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"))
    return beside(first, mad, keys, "inner")


def followed_by(df: DataFrame, keys: list[str], time: str, order: list[str], bucket: str | None, first: Column, then: Column, within: float) -> DataFrame:
    """Rows where `then` holds and the last row before where `first` held is at most `within` seconds old: with its time as since."""
    out = last_known(df, keys, bucket, order, F.when(first, F.col(time)), "since")
    return out.where(then & F.col("since").isNotNull() & (seconds_between(F.col("since"), F.col(time)) <= within))
