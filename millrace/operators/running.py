"""Running values of a series.

Without a bucket a series is one window, and operators that follow each other
share one exchange and one sort: the plan grows by a window for each. That puts
all rows of a series in one task, so it is for series of bounded length;
bucket_for() measures them.

With a bucket (a column that rises with time: a day, say) a hot series is
spread over the cluster: rows are windowed within (series, bucket), buckets are
summed up to one row each, and what each bucket starts from is carried over
those few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a series that one task may sort.
LONGEST = 5_000_000


def bucket_for(df: DataFrame, keys: list[str], bucket: str, longest: int = LONGEST) -> str | None:
    """bucket if a series of df has more than `longest` rows, else none; counts by key, which reads the keys alone."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return bucket if (most or 0) > longest else None


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with right's other columns where the keys agree; nulls agree with nulls."""
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_k_{k}" for k in keys])


def _two_levels(df: DataFrame, keys: list[str], bucket: str, own: Column, summary: Column, carry: Callable[[Window], Column]) -> DataFrame:
    """df with _own, the value within the bucket, and _from, what its bucket starts from: carry over the buckets' summaries (_s)."""
    buckets = df.groupBy(*keys, bucket).agg(summary.alias("_s"))
    buckets = buckets.withColumn("_from", carry(Window.partitionBy(*keys).orderBy(bucket))).drop("_s")
    return beside(df.withColumn("_own", own), buckets, [*keys, bucket])


def _windows(keys: list[str], bucket: str | None, order: list[str]):
    w = Window.partitionBy(*keys, *([bucket] if bucket else [])).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, 0)


def _earlier(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def last_known(df: DataFrame, keys: list[str], bucket: str | None, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the last non-null value of a series up to and including each row.

    value may be a struct. Order must tell the rows of a series apart.
    """
    _, upto = _windows(keys, bucket, order)
    df = df.withColumn("_v", value)
    own = F.last("_v", ignorenulls=True).over(upto)
    if bucket is None:
        return df.withColumn(name, own).drop("_v")
    at = F.when(F.col("_v").isNotNull(), F.struct(*order))  # rows without an order don't count
    out = _two_levels(df, keys, bucket, own, F.max_by("_v", at), lambda w: F.last("_s", ignorenulls=True).over(_earlier(w)))
    return out.withColumn(name, F.coalesce("_own", "_from")).drop("_v", "_own", "_from")


def running_sum(df: DataFrame, keys: list[str], bucket: str | None, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over a series up to and including each row (null counts 0)."""
    _, upto = _windows(keys, bucket, order)
    df = df.withColumn("_v", F.coalesce(value, F.lit(0)))
    own = F.sum("_v").over(upto)
    if bucket is None:
        return df.withColumn(name, own).drop("_v")
    out = _two_levels(df, keys, bucket, own, F.sum("_v"), lambda w: F.coalesce(F.sum("_s").over(_earlier(w)), F.lit(0)))
    return out.withColumn(name, F.col("_own") + F.col("_from")).drop("_v", "_own", "_from")


def reflected_sum(df: DataFrame, keys: list[str], bucket: str | None, order: list[str], step: Column, name: str) -> DataFrame:
    """df with `name`: s = max(0, s + step) along a series, from 0 (Lindley's recursion).

    It equals the running sum minus the least it has been so far (0 at first),
    so it needs no row-by-row state.
    """
    total = running_sum(df, keys, bucket, order, step, "_total")
    _, upto = _windows(keys, bucket, order)
    own = F.min("_total").over(upto)
    if bucket is None:
        return total.withColumn(name, F.col("_total") - F.least(F.lit(0), own)).drop("_total")
    out = _two_levels(total, keys, bucket, own, F.min("_total"), lambda w: F.least(F.lit(0), F.coalesce(F.min("_s").over(_earlier(w)), F.lit(0))))
    return out.withColumn(name, F.col("_total") - F.least("_from", "_own")).drop("_total", "_own", "_from")


def previous(df: DataFrame, keys: list[str], bucket: str | None, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: value of the row before in the series (null at its start)."""
    w, _ = _windows(keys, bucket, order)
    df = df.withColumn("_v", F.struct(value.alias("v")))
    own = F.lag("_v").over(w)
    if bucket is None:
        return df.withColumn(name, own["v"]).drop("_v")
    out = _two_levels(df, keys, bucket, own, F.max_by("_v", F.struct(*order)), lambda w: F.lag("_s").over(w))
    return out.withColumn(name, F.coalesce("_own", "_from")["v"]).drop("_v", "_own", "_from")


def following(df: DataFrame, keys: list[str], bucket: str | None, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: value of the row after in the series (null at its end)."""
    w, _ = _windows(keys, bucket, order)
    df = df.withColumn("_v", F.struct(value.alias("v")))
    own = F.lead("_v").over(w)
    if bucket is None:
        return df.withColumn(name, own["v"]).drop("_v")
    out = _two_levels(df, keys, bucket, own, F.min_by("_v", F.struct(*order)), lambda w: F.lead("_s").over(w))
    return out.withColumn(name, F.coalesce("_own", "_from")["v"]).drop("_v", "_own", "_from")
